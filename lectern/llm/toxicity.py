"""Toxicity (5): a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words compares their subsequences of three letters, gaps allowed; a gap costs
``DECAY`` a character, and what is no letter can only be a gap. "s.t-u p i d" is thus near "stupid".
Landmark words span a Nyström feature space in which a linear machine is trained. As its decision is
linear in the kernel, it is kept as one weight for each three letters, and scoring looks these up.

Labels are of documents. A sentence takes its document's label, but a toxic document has clean
sentences too: in each round a toxic document is stood for by the words of its sentences that score
highest so far, a clean one by all of its words. A document's score comes from its highest sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_BYTES, text_slices

#: A subsequence spans at most so many bytes; each byte of a gap costs the factor.
SPAN, DECAY = 7, 0.6
#: Landmarks, and rounds of choosing the words that stand for toxic documents.
LANDMARKS, ROUNDS = 256, 3
#: Words that stand for a toxic document, the least log odds of such a word, and how far below the best
#: one it may score.
WITNESSES, LEAST_ODDS, MARGIN = 4, 1.5, 1.0
#: Labelled documents of each label to learn from, and their longest text in code points.
MOST_DOCUMENTS, MOST_CHARS = 2000, 20_000
#: Weight of each disguise of a word beside the word itself.
DISGUISE_SHARE = 0.2
#: Distinct words of clean documents that the machine is trained against.
MOST_WORDS = 20_000
#: A document is judged by so many of its highest sentences.
TOP = 3

_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_CODES = 1 << 15

# 0: no letter. 1 to 26: letters. 27 to 31: the last byte of other letters; their first bytes are gaps.
_SYMBOLS = np.zeros(256, np.uint16)
_SYMBOLS[65:91] = _SYMBOLS[97:123] = np.arange(1, 27)
_SYMBOLS[128:192] = 27 + np.arange(64) % 5
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_LETTER_CODE = np.array([bool(c >> 10 and c >> 5 & 31 and c & 31) for c in range(_CODES)])


class Letters:
    """Symbols of some texts and where their units lie: words, runs of single letters being one.

    ``starts``: first byte of each unit; ``text_of`` and ``sentence_of`` its text and sentence.
    """

    def __init__(self, texts: list[str]) -> None:
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" " + b" ".join(coded) + b" " * SPAN, np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        bounds = np.cumsum([1, *(len(c) + 1 for c in coded)])
        text_of = np.searchsorted(bounds, starts, "right") - 1
        single = ends - starts == 1
        joins = np.zeros(len(starts), bool)
        joins[1:] = single[1:] & single[:-1] & (text_of[1:] == text_of[:-1])
        stop = _STOP[data[ends - 1]] & ~single
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        new_sentence = np.ones(len(starts), bool)
        new_sentence[1:] = stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]]) | (text_of[1:] != text_of[:-1])
        sentence = np.cumsum(new_sentence) - 1
        self.data = data
        self.starts, self.text_of, self.sentence_of = starts[~joins], text_of[~joins], sentence[~joins]
        # Each byte's unit, so that no subsequence goes over its end.
        first = np.zeros(len(data), bool)
        first[self.starts] = True
        self.unit = np.cumsum(first, dtype=np.int32)
        self.symbols = _SYMBOLS[data]

    def subsequences(self) -> Iterator[tuple[np.ndarray, float]]:
        """For each shape: the code at each byte (0: none begins there) and the weight."""
        size = len(self.data) - SPAN
        head = self.symbols[:size] << 10
        middle = self.symbols << 5
        for a, b in _PAIRS:
            code = head + middle[a : size + a] + self.symbols[b : size + b]
            code[self.unit[:size] != self.unit[b : size + b]] = 0
            yield code, DECAY ** (b - 2)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of weights of each unit's subsequences over the unit's norm."""
        if not len(self.starts):
            return np.zeros(0)
        total = np.zeros(len(self.data) - SPAN, np.float32)
        norm = np.zeros_like(total)
        letters = _LETTER_CODE.astype(np.float32)
        for code, weight in self.subsequences():
            total += weights[code] * np.float32(weight)
            norm += letters[code] * np.float32(weight * weight)
        sums = np.add.reduceat(total, self.starts)
        return sums / np.sqrt(np.maximum(np.add.reduceat(norm, self.starts), 1e-9))


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, weights) of each word, of norm 1 as if no subsequence came twice."""
    out = []
    for word in words:
        letters = Letters([word])
        codes, weights = [], []
        for code, weight in letters.subsequences():
            held = code[_LETTER_CODE[code]]
            codes.append(held)
            weights.append(np.full(len(held), weight))
        code, weight = np.concatenate(codes), np.concatenate(weights)
        out.append((code, weight / max(np.sqrt((weight**2).sum()), 1e-9)))
    return out


def kernel(words: list[tuple[np.ndarray, np.ndarray]], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each word with the landmarks (codes x landmarks)."""
    return np.stack([weight @ landmarks[code] for code, weight in words]) if words else np.zeros((0, landmarks.shape[1]))


def svm(rows: np.ndarray, signs: np.ndarray, weights: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton's method; the last column is the bias."""
    x = np.hstack([rows, np.ones((len(rows), 1))])

    def loss(w: np.ndarray) -> float:
        return float(w @ w + strength * (weights * np.maximum(0, 1 - signs * (x @ w)) ** 2).sum())

    w = np.zeros(x.shape[1])
    for _ in range(30):
        slack = 1 - signs * (x @ w)
        on = slack > 0
        part = x[on] * (strength * weights[on])[:, None]
        step = np.linalg.solve(part.T @ x[on] + np.eye(len(w)), w - part.T @ (signs[on] * slack[on]))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w


@dataclass
class ToxicityModel:
    """``weights`` by code of three letters, ``bias`` of a word, ``document`` logistic weights."""

    weights: np.ndarray
    bias: float
    document: np.ndarray

    def sentences(self, texts: list[str]) -> np.ndarray:
        """Per text: its ``TOP`` highest sentence scores and the logarithm of its sentences."""
        letters = Letters(texts)
        scores = letters.scores(self.weights) + self.bias
        out = np.full((len(texts), TOP + 1), -1.0)
        out[:, TOP] = 0
        if len(scores):
            first = np.flatnonzero(np.diff(letters.sentence_of, prepend=-1))
            best = np.clip(np.maximum.reduceat(scores, first), -1, 2)
            bounds = np.searchsorted(letters.text_of[first], np.arange(len(texts) + 1))
            for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                top = np.sort(best[low:high])[::-1][:TOP]
                out[i, : len(top)] = top
                out[i, TOP] = np.log1p(high - low)
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sentences(texts) @ self.document[:-1] + self.document[-1], -30, 30)))


def _words_of(text: str) -> set[str]:
    return {w for w in (x.strip(".,;:!?\"'()|").lower() for x in text.split()) if sum(c.isalpha() for c in w) > 2}


def disguised(word: str) -> list[str]:
    """Ways to write a word with characters between its letters; the machine learns from them too."""
    middle = len(word) // 2
    return [".".join(word), f"{word[:middle]}*{word[middle:]}", f"{word[:middle]}x{word[middle:]}"]


def train(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Fit on labelled documents; with one label only, every text gets that label's share."""
    toxic = np.array(labels) == 1
    if toxic.all() or not toxic.any():
        level = np.log((toxic.sum() + 0.5) / ((~toxic).sum() + 0.5))
        return ToxicityModel(np.zeros(_CODES, np.float32), 0.0, np.append(np.zeros(TOP + 1), level))
    bags = [_words_of(t) for t in texts]
    counts: list[dict[str, int]] = [{}, {}]
    for bag, label in zip(bags, toxic, strict=True):
        for word in bag:
            counts[int(label)][word] = counts[int(label)].get(word, 0) + 1
    clean_n, toxic_n = (~toxic).sum(), toxic.sum()

    def odds(word: str) -> float:
        """How much more often toxic documents have the word; a word seen once or twice says little."""
        return np.log((counts[1].get(word, 0) + 0.5) / (toxic_n + 1)) - np.log((counts[0].get(word, 0) + 2.0) / (clean_n + 4))

    # A word of one toxic document may be there by chance.
    often = [w for w, n in counts[1].items() if n > 1] or list(counts[1])
    order = sorted(often, key=lambda w: (-odds(w), w))
    clean = sorted(counts[0], key=lambda w: (-counts[0][w], w))
    spread = np.random.default_rng(5).permutation(len(clean))
    tail = [clean[i] for i in spread if i >= LANDMARKS // 4]
    against = (clean[: MOST_WORDS // 2] + tail)[:MOST_WORDS]
    landmark_words = [*order[: LANDMARKS // 2], *clean[: LANDMARKS // 4], *tail[: LANDMARKS // 4]]
    landmarks = np.zeros((_CODES, len(landmark_words)))
    for i, (code, weight) in enumerate(features(landmark_words)):
        np.add.at(landmarks[:, i], code, weight)
    values, vectors = np.linalg.eigh(landmarks.T @ landmarks)
    held = values > 1e-6 * values[-1]
    root = vectors[:, held] / np.sqrt(values[held])
    clean_rows = kernel(features(against), landmarks) @ root
    # A word that clean documents have nearly as often stands for none.
    pool = [w for w in order[: 20 * LANDMARKS] if odds(w) > LEAST_ODDS] or order[:LANDMARKS]
    pool_rows = kernel(features(pool), landmarks) @ root
    disguises = [kernel(features(list(ws)), landmarks) @ root for ws in zip(*map(disguised, pool), strict=True)]
    place = {w: i for i, w in enumerate(pool)}
    first_guess = np.array([odds(w) for w in pool])
    toxic_bags = [np.array([place[w] for w in bag if w in place], int) for bag, t in zip(bags, toxic, strict=True) if t]
    score = first_guess
    for _ in range(ROUNDS):
        witnesses = np.zeros(len(pool))
        for bag in toxic_bags:
            best = bag[np.argsort(-score[bag], kind="stable")[:WITNESSES]]
            witnesses[best[score[best] >= score[best[:1]] - MARGIN]] += 1
        chosen = np.flatnonzero(witnesses)
        share = witnesses[chosen] / witnesses.sum() * len(clean_rows) * 0.5
        rows = np.vstack([pool_rows[chosen], *(d[chosen] for d in disguises), clean_rows])
        weights = np.concatenate([share, *(share * DISGUISE_SHARE for _ in disguises), np.ones(len(clean_rows))])
        w = svm(rows, np.where(np.arange(len(rows)) < len(rows) - len(clean_rows), 1.0, -1.0), weights)
        score = pool_rows @ w[:-1] + np.minimum(first_guess, 3)
    model = ToxicityModel((landmarks @ (root @ w[:-1])).astype(np.float32), float(w[-1]), np.zeros(TOP + 2))
    model.weights[~_LETTER_CODE] = 0
    del bags, clean_rows, pool_rows, disguises, landmarks
    judged = [model.sentences(texts[i : i + 100]) for i in range(0, len(texts), 100)]
    return ToxicityModel(model.weights, model.bias, _logistic(np.vstack(judged), toxic))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.05 * np.eye(len(w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``most`` documents of each label, the first by a hash of their id.

    Only texts of up to ``MOST_CHARS`` code points are learnt from, which bounds what reaches the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    chosen = [known.where(F.col("label") == n).orderBy(F.xxhash64("id"), "id").limit(most) for n in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= MOST_CHARS)
    # At most 2 * most ids.
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").orderBy("id", "label", "text").toArrow()
    return train(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` (0 to 1) and ``predicted`` (1 if the score is ``threshold`` or more).

    A null or empty text gets the score of a text without sentences. Whole texts are scored; repeated
    rows get equal results, a null id stays null, other columns are ignored, and an empty table gives
    no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                yield pa.record_batch([part.column("id"), pa.array(model.probabilities(texts), pa.float64())], names=["id", "score"])

    scored = narrow.mapInArrow(score, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning, by the checksum of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
