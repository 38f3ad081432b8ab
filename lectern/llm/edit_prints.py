"""Document fingerprints (6) by a randomised edit embedding.

A pointer walks over the characters of a text. In step j it moves on by a number that depends on j
and the character alone, which all texts share, so that after an insertion or deletion the walks
of two texts soon meet again and stay together: edit distance becomes Hamming distance between the
sequences of what the pointer sees. Several walks share the work, as one may take long to meet. Of these steps a consistent sample is kept: a text keeps the steps of
lowest priority that its length allows, so that a longer text's sample holds what it shares with a
shorter one. Near texts are found by bands of sampled steps and verified on all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settled, stored
from lectern.llm.graph import components
from lectern.llm.words import mixed

#: Steps kept of a text; each gives a byte, 0 where the text has ended.
SLOTS = 128
#: Independent walks that share the steps kept: one may take long to meet again after an edit.
WALKS = 4
#: A step sees the hash of so many characters from the pointer on.
SEEN = 6
#: The pointer moves on by 0, 1, 2 or 3 characters, 1.5 on average.
MEAN_MOVE = 1.5
#: Characters whose texts walk together, and steps between looks at which have ended.
WALK_CHARS, LOOK = 16_000_000, 32
#: Documents of a range of ids, and the most ranges.
RANGE_DOCUMENTS, MOST_RANGES = 1000, 20_000
#: Bands for near texts, and steps in each. Two texts of likeness 0.8 share no band with a chance of 0.2 %.
BANDS, BAND_STEPS = 12, 4
#: A text has keys at its own level and so many more, so that it meets texts up to 1.4 times as long.
MORE_LEVELS = 2
#: Prints that a task compares with each other at a time.
BLOCK_PRINTS = 1024

_samples: list[np.ndarray] = [np.zeros(1, np.int64)]
_reach: list[int] = [1]


def reach(level: int) -> int:
    """Texts of ``level`` are taken to end before this step."""
    sample(level)
    return _reach[level]


def sample(level: int) -> np.ndarray:
    """The steps (ascending) of lowest priority before the level's reach, at most ``SLOTS``."""
    while len(_samples) <= level:
        start, stop = _reach[-1], max(_reach[-1] + 1, round(2 ** (len(_samples) / 4)))
        steps = _samples[-1]
        for low in range(start, stop, 1 << 20):
            steps = np.concatenate([steps, np.arange(low, min(stop, low + (1 << 20)))])
            if len(steps) > SLOTS:
                steps = steps[np.argpartition(mixed(steps.astype(np.uint64)), SLOTS)[:SLOTS]]
        _samples.append(np.sort(steps))
        _reach.append(stop)
    return _samples[level]


def level_of(chars: int) -> int:
    """The lowest level whose reach the text's walk is expected to stay in."""
    level = 0
    while reach(level) * MEAN_MOVE < chars:
        level += 1
    return level


def seen_steps(texts: list[str]) -> list[np.ndarray]:
    """For each text its level, then what the pointer sees at the sampled steps (1 to 255; 0: ended)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    coded = [texts[i].encode("utf-32-le", "surrogatepass") for i in order]
    chars = np.frombuffer(b"".join([*coded, bytes(4 * (SEEN + 4 * LOOK))]), np.uint32)
    ends = np.cumsum(lengths[order])
    at = np.repeat((ends - lengths[order])[None], WALKS, axis=0)
    known: dict[int, int] = {}
    levels = np.array([known.setdefault(int(n), level_of(int(n))) for n in lengths[order]], np.int64)
    # Texts of a level stand side by side; which slot of which level is due at a step?
    due: dict[int, list[tuple[int, int, int, int]]] = {}
    seen = [np.zeros((0, 0), np.uint8)] * len(texts)
    for level in np.unique(levels):
        low, high = np.searchsorted(-levels, [-level, -level + 1])
        block = np.zeros((high - low, len(sample(level))), np.uint8)
        for slot, step in enumerate(sample(level)):
            due.setdefault(int(step), []).append((low, high, slot, int(mixed(np.uint64([step]))[0] % np.uint64(WALKS))))
        for i in range(low, high):
            seen[i] = block[i - low]
    blocks = {int(np.searchsorted(-levels, -level)): seen[int(np.searchsorted(-levels, -level))].base for level in np.unique(levels)}
    factors = mixed(np.arange(1, SEEN + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    walking, step, moves = len(texts), 0, np.zeros((WALKS, 0), np.uint32)
    while True:
        if step % LOOK == 0:
            np.minimum(at, ends, out=at)
            left = np.flatnonzero((at[:, :walking] < ends[:walking]).any(axis=0))
            walking = int(left[-1]) + 1 if len(left) else 0
            if not walking:
                break
        if step >= moves.shape[1]:
            more = np.arange(step, step + (1 << 16), dtype=np.uint64) * np.uint64(WALKS) + np.arange(WALKS, dtype=np.uint64)[:, None]
            moves = np.concatenate([moves, (mixed(more + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)], axis=1)
        for low, high, slot, walk in due.get(step, ()):
            high = min(high, walking)
            if low < high:
                here = at[walk, low:high]
                inside = here < ends[low:high]
                total = np.zeros(high - low, np.uint32)
                for i in range(SEEN):
                    place = here + i
                    total += np.where(place < ends[low:high], chars[np.minimum(place, len(chars) - 1)] + np.uint32(1), np.uint32(0)) * factors[i]
                total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                blocks[low][: high - low, slot] = np.where(inside, (total >> np.uint32(9)) % np.uint32(255) + np.uint32(1), 0)
        front = at[:, :walking]
        front += ((chars[front] + np.uint32(1)) * moves[:, step, None]) >> np.uint32(30)
        step += 1
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    for i, text in enumerate(order):
        out[text] = np.concatenate([[np.uint8(levels[i])], seen[i]]).astype(np.uint8)
    return out


def print_of(steps: np.ndarray) -> str:
    return steps.tobytes().hex()


def steps_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), np.uint8)


def at_level(steps: np.ndarray, level: int) -> np.ndarray:
    """What is known of a text at the sampled steps of ``level``, not lower than its own."""
    own = int(steps[0])
    if own == level:
        return steps[1:]
    out = np.zeros(len(sample(level)), np.uint8)
    shared = np.flatnonzero(sample(level) < reach(own))
    out[shared] = steps[1:][np.searchsorted(sample(own), sample(level)[shared])]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the steps that agree, of those where either text goes on; 1 for two empty texts."""
    level = int(max(a[0], b[0]))
    x, y = at_level(a, level), at_level(b, level)
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 1.0


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document by descending id; the last one's next is the first. Gives id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Documents go to ranges of ids, each range with the first document of the one below, so that
    every text is shuffled once. A null text is empty; a null id comes last; rows with the same
    id go by a hash of their text, and where they are many (null ids, say) by ranges of that hash.
    Extra columns are ignored; an empty table gives no rows.
    """
    dealt = dealt_ranges(docs, id_col, text_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                chars += len(row[1])
                if chars >= WALK_CHARS:
                    yield _compared(held)
                    held = held[-1:]
                    chars = len(held[0][1])
        if held:
            yield _compared(held)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(compare, schema).withColumnRenamed("id", id_col)


def dealt_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text``, ``range`` and ``after`` (the first document of the range below), in the order in
    which the documents of a range follow each other."""
    least = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(least)), "tie": F.xxhash64("text")})
    count = rows.select("key").count()
    ranges = min(MOST_RANGES, -(-count // RANGE_DOCUMENTS)) or 1
    found = rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    # An id that is many edges at once has that many ranges.
    edges = np.array([max(least, min(int(e), -(least + 1))) for e in sorted(found)], np.int64)

    def range_at(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(edges, key, side="left"), np.searchsorted(edges, key, side="right")
        part = (tie.astype(np.float64) + 2.0**63) / 2.0**64 * (high - low + 1)
        # Ids descend through the ranges, and for one id the hashes ascend.
        return (high - np.clip(part.astype(np.int64), 0, high - low)).astype(np.int32)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(range_at(key.to_numpy(np.int64), tie.to_numpy(np.int64)))

    placed = rows.select("key", F.struct("key", F.bitwise_not("tie").alias("untie")).alias("place"), range_of("key", "tie").alias("range"))
    tops = placed.groupBy("range").agg(F.max("place").alias("top"))
    # At most MOST_RANGES rows: which range each range's first document goes to besides its own.
    tops = sorted(tops.collect())
    firsts = {(low["top"]["key"], ~low["top"]["untie"]): high["range"] for low, high in zip(tops, [*tops[1:], *tops[:1]], strict=True)}
    keys, ties = (np.array([k[i] for k in firsts], np.int64) for i in (0, 1))
    codes = _code(keys, ties)
    order = np.argsort(codes)
    keys, ties, codes = keys[order], ties[order], codes[order]
    values = np.array(list(firsts.values()), np.int32)[order]

    @F.pandas_udf("array<struct<range: int, after: boolean>>")
    def places(key: pd.Series, tie: pd.Series) -> pd.Series:
        key, tie = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        own = range_at(key, tie)
        where = np.minimum(np.searchsorted(codes, _code(key, tie)), len(codes) - 1)
        first = (keys[where] == key) & (ties[where] == tie)
        return pd.Series(
            [[{"range": int(r), "after": False}, *([{"range": int(values[w]), "after": True}] if f else [])] for r, w, f in zip(own, where, first, strict=True)]
        )

    dealt = rows.withColumn("place", F.explode(places("key", "tie"))).select("id", "text", "key", "tie", "place.range", "place.after")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "after", F.col("key").desc(), "tie")
    return dealt.select("id", "text", "range", "after")


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results for each row that is followed by another one of its range."""
    firsts = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i + 1][2] == rows[i][2]]
    edited = [rows[i][1][: len(rows[i][1]) - len(rows[i][1]) // 2] + rows[i + 1][1][: len(rows[i][1]) // 2] for i in firsts]
    steps = seen_steps([r[1] for r in rows] + edited)
    own, after = steps[: len(rows)], steps[len(rows) :]
    return pa.RecordBatch.from_pydict(
        {
            "id": pa.array([rows[i][0] for i in firsts], pa.int64()),
            "n_chars": pa.array([len(rows[i][1]) for i in firsts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([print_of(own[i]) for i in firsts], pa.string()),
            "edited_fingerprint": pa.array(map(print_of, after), pa.string()),
            "near_edited": pa.array([likeness(own[i], e) for i, e in zip(firsts, after, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(own[i], own[i + 1]) for i in firsts], pa.float64()),
        }
    )


def _code(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return mixed(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tie.astype(np.uint64))


_picked: dict[int, np.ndarray] = {}


def band_steps(level: int) -> np.ndarray:
    """For each band, which of the sampled steps of ``level`` it looks at."""
    if level not in _picked:
        steps = sample(level).astype(np.uint64)
        of_band = [np.argsort(mixed(steps + np.uint64((band + 1) << 50)))[:BAND_STEPS] for band in range(BANDS)]
        _picked[level] = np.sort(np.array(of_band), axis=1)
    return _picked[level]


def band_keys(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Level, key) of a print's bands at its own level and the next ones; a band of ended steps has none."""
    levels, keys = [], []
    for level in range(int(steps[0]), int(steps[0]) + MORE_LEVELS + 1):
        picked = band_steps(level)
        seen = at_level(steps, level)[picked]
        terms = mixed(sample(level)[picked].astype(np.uint64) * np.uint64(257) + seen)
        names = (np.uint64(level * BANDS) + np.arange(BANDS, dtype=np.uint64)) << np.uint64(32)
        # Sums of terms would forget their order; each is mixed with its place.
        sums = mixed(terms + np.arange(terms.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        some = (seen > 0).any(axis=1)
        keys.append(mixed(sums + names)[some])
        levels.append(np.full(int(some.sum()), level))
    return np.concatenate(levels), np.concatenate(keys)


def _bands(kinds: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [np.frombuffer(p, np.uint8) for p in batch.column("print").to_pylist()]
            found = [band_keys(p) for p in prints]
            if not found:
                continue
            sizes = [len(k) for _, k in found]
            ids = np.repeat(np.asarray(batch.column("id"), np.int64), sizes)
            own = np.repeat(np.array([int(p[0]) for p in prints]), sizes)
            levels, codes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            columns = [pa.array(ids), pa.array(levels.astype(np.int32)), pa.array(levels == own), pa.array(codes.view(np.int64))]
            yield pa.record_batch(columns, names=["id", "level", "own", "key"])

    return kinds.select("id", "print").mapInArrow(keys, "id long, level int, own boolean, key long")


def _alike_leads(bands: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """Links of each bucket's prints with its smallest id, so that large groups make no pairs of all with all."""
    leads = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    leads = settled(lambda: leads, "print-leads", bands.sparkSession)
    pairs = bands.join(leads, "key").where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        steps = ((np.frombuffer(p, np.uint8) for p in side) for side in (a, b))
        return pd.Series([likeness(x, y) for x, y in zip(*steps, strict=True)], dtype=float)

    sides = [kinds.select(F.col("id").alias(x), F.col("print").alias(f"{x}_print")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(alike("a_print", "b_print") >= least).select("a", "b")


def likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``likeness`` of each row of ``x`` to each of ``y``, steps of one level."""
    agree = np.zeros((len(x), len(y)), np.int32)
    some = np.zeros((len(x), len(y)), np.int32)
    for step in range(x.shape[1]):
        a, b = x[:, step, None], y[None, :, step]
        goes_on = (a > 0) | (b > 0)
        some += goes_on
        agree += goes_on & (a == b)
    return np.where(some > 0, agree / np.maximum(some, 1), 1.0)


def _alike_in_blocks(bands: DataFrame, kinds: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The links that leads miss: in buckets whose prints are still in several components, prints of different
    ones are compared in blocks inside tasks, and only links become rows.

    A pair is compared where the bucket is of the higher of its two levels, at which it is judged, so a
    bucket without a print of its own level is left out; of buckets of the same prints one is enough.
    """
    named = bands.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    buckets = named.groupBy("key", "level").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("own").alias("own"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("also"),
    )
    torn = buckets.where("low < high AND own").groupBy("level", "n", "who", "also").agg(F.min("key").alias("key"))
    torn = settled(lambda: torn.select("key", F.ceil(F.col("n") / BLOCK_PRINTS).alias("blocks")), "torn-buckets", bands.sparkSession)
    dealt = named.join(torn, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = dealt.select("id", "component", "key", "level", "blocks", "block").join(kinds.select("id", "print"), "id")
    lists = members.groupBy("key", "level", "blocks", "block").agg(F.collect_list(F.struct("id", "component", "print")).alias("members"))
    lists = stored(lists, "print-blocks")
    others = lists.where("blocks > 1").select("key", F.col("block").alias("other"), F.col("members").alias("others"))
    nothing = F.lit(None).cast(lists.schema["members"].dataType).alias("others")
    inside = lists.where(F.size("members") > 1).select("level", "members", nothing)
    across = lists.where("blocks > 1").join(others, "key").where("block < other").select("level", "members", "others")

    def side(values: pa.Array, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, of, prints = values.flatten()
        steps = [np.frombuffer(p, np.uint8) for p in prints.to_pylist()]
        own = np.array([int(x[0]) for x in steps])
        return np.asarray(ids), np.asarray(of), own, np.array([at_level(x, level) for x in steps])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                level = batch.column("level")[i].as_py()
                a = side(batch.column("members")[i].values, level)
                other = batch.column("others")[i].values
                b = a if other is None else side(other, level)
                apart = (a[1][:, None] != b[1][None, :]) & (np.maximum(a[2][:, None], b[2][None, :]) == level)
                x, y = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                linked = (likenesses(a[3][x], b[3][y]) >= least) & apart[np.ix_(x, y)]
                at = np.nonzero(linked)
                yield pa.record_batch([pa.array(a[0][x][at[0]]), pa.array(b[0][y][at[1]])], names=["a", "b"])

    found = inside.unionByName(across).mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(``fingerprint``, ``class_id``): the smallest id that links of likeness ``least`` or more lead to.

    Equal fingerprints are one class. A fingerprint has ``BANDS`` keys, each over a few of the sampled
    steps, at its own level and the next ``MORE_LEVELS``; two texts are judged at the higher of their
    levels, where both have keys. In each bucket all are compared with the smallest; what is then
    still apart in a bucket is compared in blocks. A fingerprint without any id has no class.
    """
    spark = prints.sparkSession
    rows = prints.select(F.col(id_col).cast("long").alias("id"), F.unhex("fingerprint").alias("print"))
    kinds = stored(rows.groupBy("print").agg(F.min("id").alias("id")), "prints")
    known = kinds.where("id IS NOT NULL")
    bands = stored(_bands(known), "print-bands")
    links = settled(lambda: _alike_leads(bands, known, least), "print-links", spark)
    labels = settled(lambda: components(links), "print-components", spark)
    more = settled(lambda: _alike_in_blocks(bands, known, labels, least), "more-print-links", spark)
    if not more.isEmpty():
        labels = settled(lambda: components(links.unionByName(more)), "print-components", spark)
    named = kinds.join(labels.withColumnRenamed("node", "id"), "id", "left")
    return named.select(F.lower(F.hex("print")).alias("fingerprint"), F.coalesce("component", "id").alias("class_id"))


def with_edits_and_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_edits`` and the ``class_id`` of each text: the smallest id among the texts it is near to, in steps."""
    spark = docs.sparkSession
    told = with_edits(docs, id_col, text_col)
    packed = {c: F.unhex(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    prints = settled(lambda: told.withColumns(packed), "edit-prints", spark)
    hexed = prints.withColumn("fingerprint", F.lower(F.hex("fingerprint")))
    classes = settled(lambda: near_classes(hexed, least, id_col).withColumn("fingerprint", F.unhex("fingerprint")), "print-classes", spark)
    joined = prints.join(classes, "fingerprint").select(*prints.columns, "class_id")
    return joined.withColumns({c: F.lower(F.hex(c)) for c in packed})
