"""Substring deduplication (7) by hashing lines and every run of a number of words.

Units are lines and, from each word on, the run of ``RUN_WORDS`` words. Units are normalised (case of A-Z,
white space), their digests are grouped globally, the earliest occurrence stays and the others are
removed at their offsets in the original text. As a run begins at each word, a repeated passage
goes to its very edges, whatever line or sentence it is set into.

Not every run needs to be grouped: each one has the least hash of the shorter runs inside it. Runs that
repeat share it, so those whose least hash comes once in the corpus can't be repeats. One word
in seven is such a least one; only where these repeat are the runs themselves dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import dropped, settled, stored, text_slices
from lectern.llm.words import Words, factors_of, mixed

#: A line of at least so many words is removed where it is repeated.
LINE_WORDS = 10
#: Repeated passages are removed from so many words on. A character of a script without spaces is
#: half a word.
RUN_WORDS = 20
#: A run is looked up by the least hash of its shorter runs of so many words.
SHORT_WORDS = 8

_INSIDE = RUN_WORDS - SHORT_WORDS + 1
_NO_ID = (1 << 63) - 1


def _over(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of ``size`` elements from each one on; past the end the last is repeated."""
    x = np.concatenate([x, np.repeat(x[-1:], size)])
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return (pick(x[: len(x) - rest], x[rest:]) if rest else x)


class Units:
    """Runs of words and lines of some texts, as word ranges: ``low`` and ``high`` (after the last word),
    ``text`` (whose), ``place`` (number within the text) and ``digest``. A run is named by its first word,
    and ``low`` and ``high`` are of that. Lines of enough words come after the runs of their text."""

    def __init__(self, texts: list[str]) -> None:
        self.words = words = Words(texts, apart=True)
        count = len(words.hashes)
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        last_of_line = np.zeros(count, bool)
        if count:
            next_start = np.append(words.starts[1:], len(words.data))
            last_of_line = breaks[next_start] > breaks[words.ends]
            last_of_line[words.first[1:][words.first[1:] > 0] - 1] = True
        self.weights = np.concatenate([[0], np.cumsum(np.where(words.alone, 1, 2))])
        last = np.flatnonzero(last_of_line)
        lines = np.stack([np.concatenate([[0], last[:-1] + 1])[: len(last)], last + 1])
        lines = lines[:, self.weights[lines[1]] - self.weights[lines[0]] >= 2 * LINE_WORDS]
        sizes = np.diff(words.first)
        own = np.repeat(np.arange(len(texts)), sizes)
        kind = np.repeat([0, 1], [count, lines.shape[1]])
        text = np.concatenate([own, np.searchsorted(words.first, lines[0], "right") - 1])
        order = np.lexsort((kind, text))
        self.low, self.high = np.concatenate([np.stack([np.arange(count), np.arange(count) + 1]), lines], axis=1)[:, order]
        self.text, self.line = text[order], kind[order] == 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.place = np.arange(len(self.text)) - self.first[self.text]
        # Whether a whole run begins at the word.
        self.whole = np.arange(count) + RUN_WORDS <= np.repeat(words.first[1:], sizes)

    @property
    def digest(self) -> np.ndarray:
        """Of all units; the words of a text after its last whole run have 0."""
        out = np.zeros(len(self.text), np.int64)
        whole = np.flatnonzero(self.whole)
        out[np.flatnonzero(~self.line)[whole]] = self.run_digests(whole)
        out[self.line] = self.line_digests()
        return out

    def _short(self, count: int) -> np.ndarray:
        """Digest of the ``count`` words from each word on."""
        padded = np.append(self.words.hashes, np.zeros(count, np.uint64))
        sums = np.zeros(len(self.words.hashes), np.uint64)
        for i, factor in enumerate(factors_of(count)):
            sums += padded[i : i + len(sums)] * factor
        return mixed(sums + np.uint64(count))

    def run_digests(self, at: np.ndarray) -> np.ndarray:
        return self._short(RUN_WORDS)[at].view(np.int64)

    def line_digests(self) -> np.ndarray:
        """Sums of word hashes, each times a factor for its place in the line; a line and a run of the
        same words differ, so that a line isn't a repeat of its own only run."""
        low, high = self.low[self.line], self.high[self.line]
        sizes = high - low
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        factors = factors_of(int(sizes.max()) if len(sizes) else 0)
        terms = self.words.hashes[np.repeat(low, sizes) + within] * factors[within]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) + (np.uint64(1) << np.uint64(40))).view(np.int64)

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of each run, and at which words the hash is the least of some run."""
        if not len(self.whole):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        short = self._short(SHORT_WORDS)
        runs = np.where(self.whole, _over(short, _INSIDE, np.minimum)[: len(short)], np.uint64(0))
        # A short run lies in the runs that begin up to _INSIDE - 1 words before it.
        before = _over(np.concatenate([np.zeros(_INSIDE - 1, np.uint64), runs]), _INSIDE, np.maximum)[: len(short)]
        return runs.view(np.int64), (before == short) & (before > 0)

    def removed(self, text: int, repeated: list[int]) -> np.ndarray:
        """Word ranges (rows of low, high) of the text to remove, joined where they touch."""
        own = slice(self.first[text], self.first[text + 1])
        base, stop = self.words.first[text], self.words.first[text + 1]
        marked = np.zeros(own.stop - own.start, bool)
        marked[repeated] = True
        runs = marked[: stop - base] & self.whole[base:stop]
        cover = np.zeros(stop - base + 1, bool)
        for low, high in self._joined(runs, RUN_WORDS):
            if self.weights[base + high] - self.weights[base + low] >= 2 * RUN_WORDS:
                cover[low:high] = True
        # Where runs that are alike overlap, the first one stays whole.
        at = np.flatnonzero(runs)
        if len(at):
            digests = self._digests_within(base, stop)
            for gap in range(1, RUN_WORDS):
                later = at[at >= gap]
                for i in later[(digests[later] == digests[later - gap]) & ~runs[later - gap]] - gap:
                    cover[i : i + RUN_WORDS] = False
        lines = np.flatnonzero(marked & self.line[own])
        for i in lines:
            cover[self.low[own][i] - base : self.high[own][i] - base] = True
        return np.array(self._joined(cover, 1), np.int64).reshape(-1, 2) + base

    def _digests_within(self, low: int, high: int) -> np.ndarray:
        if not hasattr(self, "_runs"):
            self._runs = self._short(RUN_WORDS)
        return self._runs[low:high]

    @staticmethod
    def _joined(marks: np.ndarray, size: int) -> list[tuple[int, int]]:
        """Ranges covered by ``size`` elements from each mark on."""
        at = np.flatnonzero(marks)
        new = np.flatnonzero(np.diff(at, prepend=-size - 1) > size)
        return [(int(at[a]), int(at[b - 1]) + size) for a, b in zip(new, np.append(new[1:], len(at)), strict=True)] if len(at) else []


def _spans(units: Units, text: int, source: str, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets (start, stop) of word ranges; a line that goes wholly takes its end along."""
    words = units.words
    begin = words.bounds[text]
    # Bytes that continue a code point don't count.
    inner = np.cumsum((words.data[begin : words.bounds[text + 1]] & 0xC0) != 0x80)
    at = lambda byte: int(inner[byte - begin - 1]) if byte > begin else 0
    spans = []
    for low, high in ranges:
        start, stop = at(words.starts[low]), at(words.ends[high - 1])
        if (start == 0 or source[start - 1] == "\n") and source[stop : stop + 1] == "\n":
            stop += 1
        spans.append((start, stop))
    return spans


def _ranked(texts: DataFrame) -> DataFrame:
    """Each distinct ``key`` and ``version`` with its ``rank``, without gaps, as a table sorted in ranges."""
    spread = texts.distinct().orderBy("key", "version").withColumn("number", F.monotonically_increasing_id())
    spread = stored(spread.withColumn("part", F.shiftright("number", 33)), "sorted-texts")
    sizes = sorted(spread.groupBy("part").count().collect())  # one row for each task
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    first = spread.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    rank = F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1)
    return stored(spread.join(F.broadcast(first), "part").select("key", "version", rank.alias("rank")), "text-ranks")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` without repeated units, and two more columns: ``removed``, an array of
    (``start``, ``length``) in code points of the original text, and ``original_chars``.

    Occurrences rank by id, then place; a null id ranks last. A line of ``LINE_WORDS`` words or more
    goes where it is repeated, any other passage from ``RUN_WORDS`` words on. Rows that repeat an id
    with the same text are one document and stay alike; with other texts they rank by two 64-bit
    hashes of the text. A null text stays null. Columns of ``docs`` that have the names of the two
    new ones are replaced. An empty table gives no rows.
    """
    # Whatever the columns are called, they can't clash with those added here.
    names = [c for c in docs.columns if c not in ("removed", "original_chars")]
    wide = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    key = F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(_NO_ID))
    text = f"c{names.index(text_col)}"
    content = F.coalesce(F.col(text), F.lit(""))
    # The seed of the second hash is another one, so that they don't collide together.
    version = F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"))
    texts = wide.select(key.alias("key"), version.alias("version"), F.col(text).alias("text"))
    per_text = settled(lambda: _repeats_by_text(texts), "repeats-by-text", docs.sparkSession)

    per_text = per_text.withColumnsRenamed({"key": "_key", "version": "_version"})
    joined = wide.withColumns({"_key": key, "_version": version}).join(per_text, ["_key", "_version"], "left").drop("_key", "_version")
    held = joined.columns[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in text_slices(batch, text):
                marks = part.column("_again").to_pylist()
                hit = [i for i, m in enumerate(marks) if m]
                units = Units([sources[i] for i in hit])
                removed: list[list[dict]] = [[] for _ in sources]
                kept = part.column(text).to_pylist()
                for n, i in enumerate(hit):
                    spans = _spans(units, n, sources[i], units.removed(n, marks[i]))
                    removed[i] = [{"start": a, "length": b - a} for a, b in spans]
                    ends = [0, *(b for _, b in spans)]
                    begins = [*(a for a, _ in spans), len(sources[i])]
                    kept[i] = "".join(sources[i][a:b] for a, b in zip(ends, begins, strict=True))
                columns = {n: part.column(n) for n in held} | {text: pa.array(kept, part.schema.field(text).type)}
                columns["removed"] = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                columns["original_chars"] = pa.array(map(len, sources), pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    span = T.StructType().add("start", "long").add("length", "long")
    schema = T.StructType(joined.schema.fields[:-1]).add("removed", T.ArrayType(span)).add("original_chars", "long")
    return joined.mapInArrow(cut, schema).toDF(*names, "removed", "original_chars")


def _repeats_by_text(texts: DataFrame) -> DataFrame:
    """``key``, ``version`` and the places (``_again``) of the units to remove, of the texts that have any."""
    kind, spark = "struct<a: bigint, b: bigint>", texts.sparkSession

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                units = Units(texts)
                runs, chosen = units.least()
                digests = np.zeros(len(units.text), np.int64)
                digests[np.flatnonzero(~units.line)[chosen]] = units._short(SHORT_WORDS)[chosen].view(np.int64)
                digests[units.line] = units.line_digests()
                held = units.line.copy()
                held[np.flatnonzero(~units.line)[chosen]] = True
                first = np.concatenate([[0], np.cumsum(held)])[units.first]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(digests[held], pa.int64()))
                yield pa.record_batch([part.column("key"), part.column("version"), lists], names=["key", "version", "digests"])

    looked = stored(texts.mapInArrow(look, f"key long, version {kind}, digests array<long>"), "least-hashes")
    ranks = settled(lambda: _ranked(looked.select("key", "version")), "text-ranks", spark)
    often = settled(lambda: _repeated_lookups(looked, ranks), "repeated-lookups", spark)
    dropped(looked)
    units = settled(lambda: _repeatable_units(texts, often), "units", spark)
    dropped(often)
    # One number for the text's rank and the place in it, in this order.
    at = F.shiftleft("rank", 31).bitwiseOR(F.col("unit.place").cast("long"))
    units = units.select("rank", F.explode("units").alias("unit")).select("unit.digest", at.alias("at"))
    ends = units.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    firsts = settled(lambda: ends.where("first < last").select("digest", "first"), "repeated-units", spark)
    again = units.join(firsts, "digest").where("at > first")
    number = F.col("at").bitwiseAND((1 << 31) - 1).cast("int")
    per_text = again.groupBy(F.shiftright("at", 31).alias("rank")).agg(F.collect_set(number).alias("_again"))
    return per_text.join(ranks, "rank").select("key", "version", "_again")


def _repeated_lookups(looked: DataFrame, ranks: DataFrame) -> DataFrame:
    """``key``, ``version``, ``rank`` and the least hashes and lines (``often``) that come more than once.

    Rows that are one document count as one only later. Should two texts share ``h``, each of them is
    also looked up by what repeats of the other: no harm.
    """
    lookups = looked.select(F.xxhash64("key", "version").alias("h"), F.explode("digests").alias("digest"))
    counted = lookups.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    repeated = settled(lambda: counted, "repeated-hashes", looked.sparkSession)
    often = lookups.join(repeated, "digest").groupBy("h").agg(F.collect_set("digest").alias("often"))
    return ranks.withColumn("h", F.xxhash64("key", "version")).join(often, "h").select("key", "version", "rank", "often")


def _repeatable_units(texts: DataFrame, often: DataFrame) -> DataFrame:
    """The digests of the lines and runs that can be repeated, with their places, of the texts that have any."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                units = Units(texts)
                runs, _ = units.least()
                lookup = np.zeros(len(units.text), np.int64)
                at_word, at_line = np.flatnonzero(~units.line), np.flatnonzero(units.line)
                lookup[at_word], lookup[at_line] = runs, units.line_digests()
                whole = np.ones(len(lookup), bool)
                whole[at_word] = units.whole
                held = np.zeros(len(lookup), bool)
                column = part.column("often")
                for i in range(part.num_rows):
                    own = slice(units.first[i], units.first[i + 1])
                    held[own] = np.isin(lookup[own], np.asarray(column[i].values)) & whole[own]
                first = np.concatenate([[0], np.cumsum(held)])[units.first]
                found = pa.StructArray.from_arrays([pa.array(units.place[held], pa.int32()), pa.array(units.digest[held], pa.int64())], names=["place", "digest"])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)
                yield pa.record_batch([part.column("rank"), lists], names=["rank", "units"])

    again = texts.join(often, ["key", "version"]).select("rank", "text", "often")
    return again.mapInArrow(digest, "rank long, units array<struct<place: int, digest: bigint>>")
