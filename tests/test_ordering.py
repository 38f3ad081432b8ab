"""Hot groups give the same rows as plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows under key 0, a null key, and ordinary keys."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).when(n % 50 == 1, None).otherwise(n % 40 + 1)
    return spark.range(3000).select(
        key.alias("k"), F.hash("id").alias("t"), "id", F.concat(F.lit("x"), "id").alias("text")
    )


def order():
    return [F.col("t").desc(), F.col("id")]


def as_set(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("hot_rows", [10**9, 500, 20])
def test_number_rows(rows, hot_rows):
    ours = O.number_rows(rows, ["k"], order(), "n", hot_rows)
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order())))
    assert as_set(ours, "k", "id", "n") == as_set(plain, "k", "id", "n")


def test_hot_groups_found_on_a_larger_frame(rows):
    part = rows.where("id % 2 = 0")
    ours = O.number_rows(part, ["k"], order(), "n", 60, counted=rows)
    assert as_set(ours, "k", "id", "n") == as_set(
        O.number_rows(part, ["k"], order(), "n"), "k", "id", "n")


@pytest.mark.parametrize("hot_rows", [10**9, 500, 20])
def test_with_next(rows, hot_rows):
    ours = O.with_next(rows, ["k"], order(), {"id": "nid", "text": "ntext"}, hot_rows)
    w = Window.partitionBy("k").orderBy(*order())
    plain = rows.withColumns({"nid": F.lead("id").over(w), "ntext": F.lead("text").over(w)})
    assert as_set(ours, "k", "id", "nid", "ntext") == as_set(plain, "k", "id", "nid", "ntext")


@pytest.mark.parametrize(
    "hot_rows,hot_bytes,block_bytes",
    [(10**9, 10**9, 10), (500, 10**9, 700), (100, 10**9, 10**9), (10**9, 20_000, 1000)],
)
def test_ordered_concat(rows, hot_rows, hot_bytes, block_bytes):
    line = F.concat(F.col("_n").cast("string"), F.lit(":"), F.col("text"))
    got = O.ordered_concat(
        rows, ["k"], order(), ", ", {"line": line, "text": F.col("text")}, {"odd": F.col("id") % 2},
        hot_rows, hot_bytes, block_bytes, text_bytes=F.octet_length("text"),
    ).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.t, r.id)):
        want.setdefault(r.k, []).append(r)
    assert len(got) == len(want)
    for r in got:
        group = want[r.k]
        assert r.rows == len(group)
        assert r.odd == sum(x.id % 2 for x in group)
        assert r.text == ", ".join(x.text for x in group)
        assert r.line == ", ".join(f"{i}:{x.text}" for i, x in enumerate(group, 1))


@pytest.fixture(scope="module")
def heavy(spark):
    """A group with few long rows beside one with many short ones, and ordinary groups."""
    n = F.col("id")
    return spark.range(4000).select(
        F.when(n < 40, "long").when(n < 2000, "many").otherwise(F.concat(F.lit("k"), n % 100)).alias("k"),
        F.xxhash64("id").alias("t"), "id",
        F.when(n < 40, F.repeat(F.lit("long text "), 10_000)).otherwise(F.concat(F.lit("x"), "id")).alias("text"),
    )


def test_few_long_rows_are_hot_by_their_bytes(heavy):
    measure = lambda hot_bytes: O._measured(heavy, ["k"], 10**6, F.octet_length("text"), hot_bytes)
    assert [(r.k, r._rows, r._bytes) for r in measure(1 << 20).collect()] == [("long", 40, 4_000_000)]
    assert measure(1 << 30) is None


@pytest.mark.parametrize("partitions", ["2", "300"])
def test_pieces_follow_the_size_and_not_the_shuffle_setting(spark, heavy, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        _, hot = O._split(heavy, ["k"], 10**6, None, F.octet_length("text"), 1 << 20)
        assert hot.pieces == 4 and hot.rows.count() == 40
        _, hot = O._split(heavy, ["k"], 500)
        assert hot.pieces == 4 and hot.rows.count() == 1960
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_of_long_rows_hold_about_the_bytes_they_should(heavy):
    weight = F.octet_length("text").cast("long")
    _, hot = O._split(heavy, ["k"], 10**6, None, weight, 1 << 20)
    numbered = O._number_hot(hot, ["k"], order(), "n", weight).collect()
    upto = 0
    for r in sorted(numbered, key=lambda r: r.n):
        assert r._upto == upto
        upto += len(r.text)
    assert [r.n for r in sorted(numbered, key=lambda r: r.n)] == list(range(1, 41))
    got = O.ordered_concat(
        heavy, ["k"], order(), "|", {"text": F.col("text")}, hot_bytes=1 << 20, block_bytes=250_000,
        text_bytes=F.octet_length("text"),
    )
    row = got.where("k = 'long'").first()
    assert row.rows == 40 and row.text == "|".join(["long text " * 10_000] * 40)


def test_first_rows_limits_before_the_shuffle(rows):
    df = O.first_rows(rows, ["k"], order(), 3, "n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_latest_per_key(rows):
    got = as_set(O.latest_per_key(rows, ["k"], order()), "k", "id")
    best = {}
    for r in rows.collect():
        if r.k not in best or (-r.t, r.id) < best[r.k]:
            best[r.k] = (-r.t, r.id)
    assert got == {(k, v[1]) for k, v in best.items()}
