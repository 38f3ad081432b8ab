"""Mixing against a plain water filling and its own promises."""

import random

from lectern.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, capped, total = set(names), {}, sum(sizes.values())
    while free:
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in above}
        free -= above
    return capped


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def sample_rows():
    chance = random.Random(7)
    rows = []
    for i in range(900):
        source = chance.choice(["a"] * 6 + ["b", "c", "é", "Z", None, "tiny"])
        words = 0 if i % 41 == 0 else int(chance.lognormvariate(3, 1.2)) + 1
        if source == "tiny":
            words = 1
        rows.append((i, None if i % 97 == 0 else "\t".join(["w"] * words), source, "clash"))
    return rows


def test_targets_and_taken(spark):
    rows = sample_rows()
    got = mixing.mixed_documents(documents(spark, rows)).toPandas()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    source_of = {r[0]: r[2] for r in rows}
    assert sorted(got.doc_id) == sorted(source_of)
    got["src"] = got.doc_id.map(source_of)
    for source, held in got.groupby("src", dropna=False):
        source = source if isinstance(source, str) else None
        assert held.source_size.eq(sizes[source]).all()
        assert abs(held.target.iloc[0] - want[source]) < 1e-6
        assert abs(held.taken.sum() - want[source]) <= max(5, 0.01 * want[source])
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()


def test_reruns_agree_and_chances_hold(spark):
    rows = sample_rows()
    first = mixing.mixed_documents(documents(spark, rows)).toPandas().sort_values("doc_id")
    again = mixing.mixed_documents(documents(spark, rows[::-1])).toPandas().sort_values("doc_id")
    assert list(first.taken) == list(again.taken)
    # Large and small documents of a source are taken about equally often.
    some = first[first["size"] > 0].merge(documents(spark, rows).select("doc_id", "source").toPandas(), on="doc_id")
    hot = some[some.source == "a"]
    large = hot["size"] > hot["size"].median()
    assert abs(hot.copies[large].mean() - hot.copies[~large].mean()) < 0.2


def test_expected_copies_do_not_depend_on_size(spark):
    # Each source is one more trial of the same sizes, the first a very long one.
    sizes = [20_000] + [int(40 * 1.2**k) for k in range(20)]
    trials, part = 600, 0.9
    rows = [(t * 100 + k, f"s{t}", n) for t in range(trials) for k, n in enumerate(sizes)]
    targets = [(f"s{t}", sum(sizes), part * sum(sizes)) for t in range(trials)]
    copies = mixing.rounded_copies(
        spark.createDataFrame(rows, "id long, source string, size long"),
        spark.createDataFrame(targets, "source string, source_size long, target double"),
    ).toPandas()
    by_rank = copies.groupby(copies.id % 100).copies.mean()
    assert len(by_rank) == len(sizes) and (by_rank - part).abs().max() < 0.055


def test_repeated_rows_and_edges(spark):
    rows = [(1, "x y", "s", "")] * 40 + [(None, "z", "s", ""), (2, None, None, ""), (3, "", "e", ""), (4, "w " * 50_000, "s", "")]
    got = mixing.mixed_documents(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    assert got[got.doc_id == 1].taken.nunique() == 1
    assert got[got.doc_id == 3].target.iloc[0] == 0 and got[got.doc_id == 2].taken.iloc[0] == 0


def test_no_rows(spark):
    assert mixing.mixed_documents(documents(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = mixing.mixed_documents(documents(spark, sample_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
