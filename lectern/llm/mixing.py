"""Mixing sources to target weights (2) by pivotal dependent rounding, in DataFrame operations only.

A source that is to be taken f times gives each of its documents floor(f) copies and one more with
probability f - floor(f). These probabilities are rounded dependently: two documents exchange word
mass at random until one of them is decided, and the other goes on with what is left. The words
taken from a source then stay what they should be, up to a part of a single document, while each
document's expected copies stay f. Documents are dealt to blocks, a block folds its documents to one
undecided document, and these are dealt to blocks again: a reduction tree with a wide fan-in. In the
first blocks a document's partner is all that are smaller, so that large ones are decided first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored, words_in

#: Documents that a block folds at a time.
BLOCK_DOCUMENTS = 128


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """Per source of ``sizes`` (``source``, ``size``): ``source_size`` and ``target``.

    Sources in code point order, null last, get the weights in turn and share ``share`` of all words
    by weight, none more than ``most`` times its size; what is above goes to the others by weight.
    The level c with target = min(most * size, c * weight) is found by a few aggregates of one row
    over the sources, each of which caps those that are above at the level so far.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = stored(
        per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1)), "sources"
    )
    cap = F.col("source_size") * F.lit(most)
    all_words, all_weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * (all_words or 0) / all_weight if all_weight else 0.0
    capped = -1
    while True:
        above = F.lit(level) * F.col("weight") > cap
        kept, free, count = weighted.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if count == capped or not free:
            break
        capped = count
        level = (share * (all_words or 0) - (kept or 0)) / free
    return weighted.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _chance(*of: Column) -> Column:
    """A number from 0 to 1 that depends on ``of`` alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*of), 12) / F.lit(float(1 << 52))


def _exchange(state: Column, other: Column) -> Column:
    """Fold ``other`` into the undecided document of ``state``: one of the two gets decided.

    The undecided document rises by ``up`` with the chance down / (up + down) and else falls by ``down``, so
    that both keep their expected copies. Each exchange has a draw of its own, made of the two
    documents' (which depend on the seed); no two documents meet twice.
    """

    def exchanged(x: Column) -> Column:
        a, b, up, down, rises = x["a"], x["b"], x["up"], x["down"], x["rises"]
        moved = F.when(rises, up).otherwise(-down)
        a_ends = F.when(rises, (1 - a["p"]) * a["mass"] <= up).otherwise(a["p"] * a["mass"] <= down)
        a_after = a.withField("p", a["p"] + moved / a["mass"])
        b_after = b.withField("p", b["p"] - moved / b["mass"])
        decided = F.when(a_ends, a_after.withField("p", rises.cast("double"))).otherwise(
            b_after.withField("p", (~rises).cast("double"))
        )
        return F.struct(
            F.when(a_ends, b_after).otherwise(a_after).alias("open"),
            F.concat(state["done"], F.array(decided)).alias("done"),
        )

    a, b = state["open"], other
    up = F.least((1 - a["p"]) * a["mass"], b["p"] * b["mass"])
    down = F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"])
    rises = _chance(a["draw"], b["draw"]) * (up + down) < down
    pair = F.struct(a.alias("a"), b.alias("b"), up.alias("up"), down.alias("down"), rises.alias("rises"))
    return F.transform(F.array(pair), exchanged)[0]


def _decided_by_rest(state: Column, doc: Column) -> Column:
    """Decide ``doc``, the largest left of a block whose documents share ``p``, against all that are smaller.

    It rises or falls as in ``_exchange``, and the smaller ones (of mass ``rest`` in all) move the other way
    by the same amount each. Thus the large documents are decided first, and the smallest one stays
    open, unless a document is too large for the rest to make up for it: then that one does.
    """

    def decided(x: Column) -> Column:
        doc, p, rest, rises = x["doc"], x["p"], x["rest"], x["rises"]
        ends = F.when(rises, (1 - p) * doc["mass"] <= x["up"]).otherwise(p * doc["mass"] <= x["down"])
        moved = F.when(rises, x["up"]).otherwise(-x["down"])
        others = F.when(ends, F.least(F.greatest(p - moved / rest, F.lit(0.0)), F.lit(1.0))).otherwise((~rises).cast("double"))
        stays = F.when(rest > 0, ~ends).otherwise(x["open"].isNull())
        after = doc.withField("p", F.when(rest <= 0, p).when(ends, rises.cast("double")).otherwise(p + moved / doc["mass"]))
        return F.struct(
            F.when(rest > 0, others).otherwise(p).alias("p"), rest.alias("rest"),
            F.when(stays, after).otherwise(x["open"]).alias("open"),
            F.when(stays, x["done"]).otherwise(F.concat(x["done"], F.array(after))).alias("done"),
        )

    p, rest = state["p"], state["rest"] - doc["mass"]
    up = F.least((1 - p) * doc["mass"], p * rest)
    down = F.least(p * doc["mass"], (1 - p) * rest)
    rises = _chance(doc["draw"]) * (up + down) < down
    # Where all that are left are decided, nothing moves.
    rises = F.when((up + down) > 0, rises).otherwise(p >= 1)
    held = F.struct(doc.alias("doc"), p.alias("p"), rest.alias("rest"), up.alias("up"), down.alias("down"), rises.alias("rises"), state["open"].alias("open"), state["done"].alias("done"))
    return F.transform(F.array(held), decided)[0]


def _folded(open_docs: DataFrame, level: int) -> DataFrame:
    """One level of the tree: ``open_docs`` (``source``, ``blocks``, ``doc``) by source and block,
    to ``doc`` (still undecided) and ``done``. The largest documents of a block come first, so that
    a small one is left. On level 0 all documents of a source have the same probability."""
    block = F.pmod(F.xxhash64("doc.draw", F.lit(level)), F.col("blocks"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("doc.mass")).alias("o"), F.col("doc.draw").alias("d"), F.col("doc").alias("doc"))))
    grouped = open_docs.groupBy("source", "blocks", block.alias("block")).agg(F.transform(ordered, lambda x: x["doc"]).alias("docs"))
    none = F.slice("docs", 1, 0).alias("done")
    if level == 0:
        mass = F.aggregate("docs", F.lit(0.0), lambda a, x: a + x["mass"]).alias("rest")
        opened = F.when(F.size("docs") < 0, F.col("docs")[0]).alias("open")
        state = F.aggregate("docs", F.struct(F.col("docs")[0]["p"].alias("p"), mass, opened, none), _decided_by_rest)
    else:
        rest = F.slice("docs", F.lit(2), F.size("docs"))
        state = F.aggregate(rest, F.struct(F.col("docs")[0].alias("open"), none), _exchange)
    return grouped.select("source", "blocks", state.alias("state")).select(
        "source", "blocks", F.col("state.open").alias("doc"), F.col("state.done").alias("done")
    )


def rounded_copies(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Per distinct (``id``, ``source``, ``size``) of ``sizes``: ``rows``, ``copies`` and its source's
    ``source_size`` and ``target``."""
    units = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    units = stored(units, "units")
    # A target of 0 takes no document, so a source without words needs no share.
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = units.where("size > 0").groupBy("source").agg(F.ceil(F.count("*") / BLOCK_DOCUMENTS).alias("blocks"))
    sources = stored(
        _with_source(targets, filled, "left").select(
            "*", F.floor(times).alias("whole"), (times - F.floor(times)).alias("part")
        ),
        "source-shares",
    )
    doc = F.struct(
        (F.col("size") * F.col("rows")).cast("double").alias("mass"),
        F.col("part").alias("p"),
        F.xxhash64("id", "source", "size", F.lit(seed)).alias("draw"),
        "id", "size", "rows",
    )
    level, decided = 0, []
    open_docs = _with_source(units.where("size > 0"), sources, "inner").select("source", "blocks", doc.alias("doc"))
    while True:
        folded = stored(_folded(open_docs, level), f"folded-{level}")
        decided.append(folded.select("source", F.explode("done").alias("doc")))
        if folded.where("blocks > 1").isEmpty():
            break
        level += 1
        open_docs = folded.select("source", F.ceil(F.col("blocks") / BLOCK_DOCUMENTS).alias("blocks"), "doc")
    # The last document of a source has none to exchange with: its probability is its chance.
    last = F.col("doc").withField("p", (_chance(F.col("doc.draw"), F.lit(seed)) < F.col("doc.p")).cast("double"))
    decided.append(folded.select("source", last.alias("doc")))
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.select("source", "doc.id", "doc.size", "doc.rows", F.round("doc.p").cast("long").alias("one_more"))
    empty = units.where("size <= 0").select("source", "id", "size", "rows", F.lit(0).cast("long").alias("one_more"))
    return _with_source(drawn.unionByName(empty), sources, "inner").select(
        "id", "source", "size", "rows", (F.col("whole") + F.col("one_more")).cast("long").alias("copies"), "source_size", "target"
    )


def _with_source(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Null-safe join on ``source``; a hot source is split at run time as both sides are stored."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id``, ``source`` and ``size`` (words) of each row, stored: the texts are read once."""
    return stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sizes"
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``copies``.

    A null text has size 0 and gives nothing to take; a null source is a source of its own, the last
    one. Rows that repeat an id with the same source and size share one decision. Reruns agree,
    as chance comes from hashes. Extra columns are ignored; an empty table gives no rows.
    """
    sizes = document_sizes(docs, id_col, text_col, source_col)
    copies = rounded_copies(sizes, source_targets(sizes, weights, most, share))
    return copies.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
