"""Words of many texts at once as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from lectern.llm.common import SPACE_BYTES

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors_of(count: int) -> np.ndarray:
    """Odd factors by which the hashes of a sequence are told apart by place."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _alone(data: np.ndarray) -> np.ndarray:
    """Bytes of the characters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, Kana, Han."""
    following = np.append(data[1:], np.uint8(0))
    lead = ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (following >= 0xB8)) | ((data == 0xE1) & ((following <= 0x82) | (following == 0x9E) | (following == 0x9F)))
    lead |= (data == 0xF0) & (following >= 0xA0)
    alone = lead.copy()
    for n in (1, 2):
        alone[n:] |= lead[:-n]
    alone[3:] |= lead[:-3] & (data[:-3] == 0xF0)
    return alone


class Words:
    """``data``: the texts' UTF-8 bytes with a space around each; ``starts``, ``ends``: of the words
    there; ``hashes``: of the words with A-Z lower-cased; ``first``: the first word of each text and
    the end; ``bounds``: the first byte of each text and the end.

    The hash of a word is a polynomial of its bytes, by differences of one running sum, then mixed.
    With ``apart`` each character of a script without spaces is a word; ``alone`` tells which these are.
    """

    def __init__(self, texts: list[str], apart: bool = False) -> None:
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
        space = _SPACE[self.data]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.alone = np.zeros(len(self.starts), bool)
        if apart and (self.data >= 0xE0).any():
            alone = _alone(self.data)
            begins = ~space[1:] & (space[:-1] | ((self.data[1:] & 0xC0) != 0x80) & (alone[1:] | alone[:-1]))
            self.starts = np.flatnonzero(begins) + 1
            self.ends = np.flatnonzero(~space[:-1] & (space[1:] | begins)) + 1
            self.alone = alone[self.starts]
        values = self.data.astype(np.uint64) + np.uint64(1)
        values[(self.data >= 65) & (self.data <= 90)] += np.uint64(32)
        powers = np.full(len(self.data), _BASE)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
        powers[1:] = _INVERSE
        np.cumprod(powers, out=powers)
        own = (sums[self.ends] - sums[self.starts]) * powers[self.starts]
        self.hashes = mixed(own + (self.ends - self.starts).astype(np.uint64))
        self.bounds = np.cumsum([1, *(len(c) + 1 for c in coded)])
        self.first = np.searchsorted(self.starts, self.bounds)
