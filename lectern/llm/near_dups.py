"""MinHash near-duplicates (4) by sequential Bayesian verification.

One pass over the texts gives each document its set size, a digest of its shingle set, band keys and
a signature. Equal sets are one class. In each bucket of a band every class is compared with the
smallest one of the bucket; classes that this leaves in different components are then compared with
each other block by block. Signatures are compared a batch of hashes at a time, and a pair is dropped
once the posterior chance that its similarity reaches the threshold is below ``MISS``. Survivors are
confirmed on the full sets. Pairs become rows only against the smallest of a bucket or as links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, text_slices
from lectern.llm.graph import components
from lectern.llm.words import Words, factors_of, mixed

#: Bands of so many hashes each: at similarity 0.8 a pair shares no band with a chance of 7e-6.
BANDS, BAND_HASHES = 30, 5
#: Hashes compared at a time, and the chance at which a true link may be dropped.
BATCH, MISS = 30, 1e-6
#: Classes of a bucket that one task compares with each other at a time.
BLOCK_CLASSES = 256
#: Up to so many ids (8 bytes each) are sent to all tasks to pick their texts; more are joined.
BROADCAST_IDS = 4_000_000

_HASHES = BANDS * BAND_HASHES
_RANDOM = np.random.default_rng(4).integers(0, 1 << 63, (3, _HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles (64-bit) of each text; with fewer words, all of them as one."""
    found = Words(texts)
    words, first = found.hashes, found.first
    factors = factors_of(width)
    spans = max(0, len(words) - width + 1)
    joined = np.zeros(spans, np.uint64)
    for i in range(width):
        joined += words[i : i + spans] * factors[i]
    joined = mixed(joined)
    out = []
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= width:
            out.append(np.unique(joined[low : high - width + 1]))
        elif high > low:
            few = (words[low:high] * factors[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            out.append(mixed(np.array([few])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values (one row per set, none of them empty)."""
    all_of, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((_HASHES, len(sets)), np.uint64)
    for i in range(_HASHES):
        out[i] = np.minimum.reduceat((all_of ^ _RANDOM[2, i]) * _RANDOM[0, i] + _RANDOM[1, i], starts)
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(values), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_HASHES):
        keys = mixed(keys ^ values[:, i::BAND_HASHES])
    return keys


def least_matches(similarity: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on) after each batch.

    With a uniform prior the posterior after m matches of n is a beta distribution, and the chance
    of at least ``similarity`` is that of at most m successes in n + 1 trials.
    """
    bounds = []
    for n in range(BATCH, _HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        bounds.append((n, m))
    return bounds


def likely(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of the signatures ``a`` and ``b`` stay after all batches."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    before = 0
    for n, least in bounds:
        matches[left] += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        left, before = left[matches[left] >= least], n
    return left


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, _HASHES)


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """``id``, ``n`` (set size), ``digest`` of the set (null if empty), ``keys``, ``signature``."""
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts, width)
                some = [s for s in sets if len(s)]
                values = minima(some) if some else np.zeros((0, _HASHES), np.uint64)
                keys = iter(band_keys(values).view(np.int64))
                short = iter((values & np.uint64(0xFFFF)).astype(np.uint16))
                columns = [part.column("id"), pa.array(map(len, sets), pa.int64())]
                columns.append(pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()))
                columns.append(pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())))
                columns.append(pa.array([next(short).tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.record_batch(columns, names=["id", "n", "digest", "keys", "signature"])

    return rows.mapInArrow(sketch, f"id {kind}, n long, digest binary, keys array<long>, signature binary")


def likely_pairs(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures don't rule out the similarity."""
    bounds = least_matches(similarity)
    kind = pairs.schema["a"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = likely(_signatures(batch.column("a_sig")), _signatures(batch.column("b_sig")), bounds)
            yield batch.take(pa.array(left)).select(["a", "b"])

    sides = [sketched.select(F.col("id").alias(x), F.col("signature").alias(f"{x}_sig")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_sig", "b_sig").mapInArrow(keep, f"a {kind}, b {kind}")


def _sets(ids: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(``id``, ``shingles``) of the stored ``ids``."""
    few = ids.count() <= BROADCAST_IDS
    kind = rows.schema["id"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
                yield pa.record_batch([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    chosen = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return stored(chosen.mapInArrow(fill, f"id {kind}, shingles array<long>"), "shingle-sets")


def confirmed(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= ``percent`` * union."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(stored(ends, "pair-ids"), rows, width)
    sides = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab"]
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return pairs.join(sides[0], "a").join(sides[1], "b").where(100 * common >= percent * union).select("a", "b").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Members (``key``, ``id``, ``component``, ``sketch``) of each bucket in blocks of bounded size:
    rows (``members``, ``others``) for each block (``others`` null) and each two blocks."""
    sizes = stored(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_CLASSES).alias("blocks")), "bucket-sizes")
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    lists = stored(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("id", "component", "sketch")).alias("members")), "blocks")
    others = lists.select("key", F.col("block").alias("other"), F.col("members").alias("others"))
    none = F.lit(None).cast(lists.schema["members"].dataType).alias("others")
    inside = lists.where(F.size("members") > 1).select("members", none)
    return inside.unionByName(lists.join(others, "key").where("block < other").select("members", "others"))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[pa.Array]]]:
    """(Columns of the members, columns of the others); without others, the members again."""
    for batch in batches:
        for i in range(batch.num_rows):
            members = batch.column("members")[i].values.flatten()
            others = batch.column("others")[i].values
            yield members, members if others is None else others.flatten()


def _apart(x_of: list, y_of: list) -> np.ndarray:
    """Which members are in different components."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(c, len(codes)) for c in of]) for of in (x_of, y_of))
    return x[:, None] != y[None, :]


def _links_in_blocks(members: DataFrame, similarity: float, percent: int) -> DataFrame:
    """Links between different components of a bucket: of the pairs that their signatures leave, those
    that the full sets confirm. Only links become rows."""
    bounds = least_matches(similarity)
    kind = members.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _each_block(batches):
            apart = _apart(x[1].to_pylist(), y[1].to_pylist())
            x_sig, y_sig = (_signatures(side[2].field("signature")) for side in (x, y))
            x_sets, y_sets = (side[2].field("shingles") for side in (x, y))
            sizes = [np.diff(np.asarray(sets.offsets)) for sets in (x_sets, y_sets)]
            values, codes = np.unique(np.concatenate([np.asarray(sets.flatten()) for sets in (x_sets, y_sets)]), return_inverse=True)
            x_codes, y_codes = codes[: sizes[0].sum()], codes[sizes[0].sum() :]
            x_ends, y_ends = np.cumsum(sizes[0]), np.cumsum(sizes[1])
            a, b = [], []
            for i in np.flatnonzero(apart.any(axis=1)):
                others = np.flatnonzero(apart[i])
                left = others[likely(np.broadcast_to(x_sig[i], (len(others), _HASHES)), y_sig[others], bounds)]
                if not len(left):
                    continue
                held = np.zeros(len(values), np.int64)
                held[x_codes[x_ends[i] - sizes[0][i] : x_ends[i]]] = 1
                common = np.add.reduceat(held[y_codes], y_ends - sizes[1])[left]
                linked = left[100 * common >= percent * (sizes[0][i] + sizes[1][left] - common)]
                a += [i] * len(linked)
                b += linked.tolist()
            yield pa.RecordBatch.from_arrays([x[0].take(pa.array(a, pa.int64())), y[0].take(pa.array(b, pa.int64()))], names=["a", "b"])

    found = _blocks(members).mapInArrow(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``.

    Documents whose sets of ``width``-word shingles meet 100 * intersection >= ``percent`` * union are
    linked. A text of fewer words is one shingle; a null text or one without words has none and is
    linked with nothing. Rows that repeat an id get the same component; if their texts differ, the
    one with the smallest digest stands for the id. A null id has a null component and is kept.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    similarity = percent / 100
    every = stored(sketches(rows, width), "sketches")
    sketched = every.where("id IS NOT NULL AND n > 0")
    if not sketched.groupBy("id").count().where("count > 1").isEmpty():
        one = F.min_by(F.struct("digest", "keys", "signature"), "digest")
        sketched = stored(sketched.groupBy("id").agg(one.alias("s")).select("id", "s.*"), "one-per-id")

    # Equal sets: the smallest id stands for its class.
    classes = sketched.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    classes = stored(classes.select("digest", "first"), "classes")
    copies = stored(sketched.select("id", "digest").join(classes, "digest").where("id <> first").select("id", "first"), "copies")
    single = sketched.join(copies.select("id"), "id", "left_anti")

    # First each member of a bucket against the smallest.
    bands = single.select(F.explode("keys").alias("key"), "id")
    leads = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    leads = stored(leads.select("key", "lead"), "leads")
    members = stored(bands.join(leads, "key").where("id <> lead"), "members")
    pairs = stored(members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    likely_ones = stored(likely_pairs(pairs, sketched, similarity), "likely")
    links = stored(confirmed(likely_ones, rows, width, percent), "confirmed")
    labels = components(links)

    # Then those members against each other that are still in different components.
    label = labels.withColumnRenamed("node", "id")
    placed = stored(members.select("key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    torn = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d")
    torn = stored(torn.select("key"), "torn")
    if not torn.isEmpty():
        rest = stored(placed.join(torn, "key"), "torn-members")
        sets = _sets(stored(rest.select("id").distinct(), "member-ids"), rows, width)
        sketch = F.struct("signature", "shingles").alias("sketch")
        full = rest.join(sketched.select("id", "signature"), "id").join(sets, "id").select("key", "id", "component", sketch)
        more = stored(_links_in_blocks(full, similarity, percent), "more-confirmed")
        # What is linked now are the components found so far.
        ends = [label.select(F.col("id").alias(x), F.col("component").alias(f"{x}_of")) for x in "ab"]
        more = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
        merged = components(more.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
        merged = merged.select(F.col("component").alias("merged"), F.col("node").alias("component"))
        moved = labels.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
        single_ones = merged.withColumnRenamed("component", "node").join(labels.select("node"), "node", "left_anti")
        labels = stored(moved.unionByName(single_ones.withColumnRenamed("merged", "component")), "labels")

    place = every.select("id", "n").join(copies, "id", "left").withColumn("node", F.coalesce("first", "id"))
    placed = place.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    kept: Column = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
