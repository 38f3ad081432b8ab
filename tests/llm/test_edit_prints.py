"""Edit fingerprints: edited texts by brute force, and likeness that follows edit distance."""

import glob
import hashlib
import random
import time
from statistics import mean

from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm import edit_prints as E


def text(chance, n):
    return "".join(chance.choices("abcdefghijklmnopqrstuvwxyz     é", k=n))


def edited(chance, t, edits):
    t = list(t)
    for _ in range(edits):
        at = chance.randrange(len(t))
        chance.choice([lambda: t.insert(at, "x"), lambda: t.pop(at), lambda: t.__setitem__(at, "y")])()
    return "".join(t)


def near(a, b):
    x, y = E.seen_steps([a, b])
    return E.likeness(x, y)


def brute(rows, ties=None):
    """(id, n_chars, sha256, fingerprint) of each row; next comes the following smaller id, then the first."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]] if ties else 0))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = E.seen_steps([t, new, after])
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), E.print_of(a), E.print_of(b), E.likeness(a, b), E.likeness(a, c)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = [tuple(r) for r in E.with_edits(df).collect()]
    ties = {r.text: r.tie for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    assert sorted(got, key=str) == sorted(brute(rows, ties), key=str)


def test_rows(spark, monkeypatch):
    chance = random.Random(1)
    monkeypatch.setattr(E, "RANGE_DOCUMENTS", 7)
    monkeypatch.setattr(E, "WALK_CHARS", 3000)
    rows = [(chance.randrange(10**6) - 5000, text(chance, chance.randrange(600))) for _ in range(80)]
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "\U0001f600 é"), (None, "null id"), (-9000, "long " * 20_000)]
    check(spark, rows)


def test_nul_characters_end(spark):
    check(spark, [(1, "\0"), (2, "a\0\0b" * 50), (3, "\0" * 500), (4, "plain")])
    assert near("\0" * 500, "\0" * 500) == 1


def test_few_rows(spark):
    check(spark, [(1, "alone")])
    check(spark, [(1, "one"), (2, "two")])
    check(spark, [])
    # Rows that repeat an id with the same text follow each other.
    check(spark, [(1, "one"), (3, "same words"), (3, "same words"), (5, "five")])


def test_likeness_follows_edits():
    chance = random.Random(2)
    means = []
    for edits in (0, 2, 20, 200):
        texts = [text(chance, 2000) for _ in range(12)]
        means.append(mean(near(t, edited(chance, t, edits)) for t in texts))
    assert means[0] == 1 and means[1] > 0.8 and means[0] > means[1] > means[2] > means[3] and means[3] < 0.3
    assert mean(near(text(chance, 2000), text(chance, 2000)) for _ in range(10)) < 0.05


def test_length_may_differ():
    chance = random.Random(3)
    t = text(chance, 4000)
    assert near(t, t + text(chance, 400)) > 0.75 and 0.35 < near(t, t[:2000]) < 0.65
    assert near("", "") == 1 and near("", "a") == 0 and near("a", "a") == 1


def test_a_longer_sample_holds_what_it_shares():
    for level in range(4, 70):
        low = {s for s in E.sample(level + 1).tolist() if s < E.reach(level)}
        assert low <= set(E.sample(level).tolist())


def all_pairs(rows, least=0.8):
    """Classes by comparing everything: id to the smallest id reachable."""
    steps = [(i, E.seen_steps([t])[0]) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(i, j) for n, (i, a) in enumerate(steps) for j, b in steps[:n] if E.likeness(a, b) >= least]
    for i, j in links:
        x, y = sorted((top(i), top(j)))
        up[y] = x
    return {i: top(i) for i in up}, links


def classes(spark, rows):
    prints = spark.createDataFrame([(i, E.print_of(E.seen_steps([t])[0])) for i, t in rows], "doc_id long, fingerprint string")
    by_print = {r.fingerprint: r.class_id for r in E.near_classes(prints).collect()}
    return {r.doc_id: by_print[r.fingerprint] for r in prints.collect()}


def test_near_classes_are_those_of_all_pairs(spark):
    """Copies, edits and prefixes of many sizes, at the default likeness."""
    chance = random.Random(4)
    rows = []
    for group in range(40):
        base = text(chance, chance.choice([30, 200, 1500, 4000]))
        for n in range(4):
            kind = chance.randrange(4)
            more = [base, edited(chance, base, 1 + len(base) // 800), base[: int(len(base) * 0.9)], base + text(chance, len(base) // 8)][kind]
            rows.append((group * 10 + n, more))
    rows += [(1000 + i, text(chance, 1500)) for i in range(20)] + [(2000, ""), (2001, "")]
    want, links = all_pairs(rows)
    got = classes(spark, rows)
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 60 and found >= 0.99 * len(links)
    assert all(want[got[i]] == want[i] for i in want)  # nothing is linked that all pairs wouldn't link


def test_a_link_beside_the_smallest_of_a_bucket_is_found(spark):
    """A text that shares a part with two that are alike is the smallest id of their common buckets."""
    chance = random.Random(5)
    rows = []
    for group in range(30):
        shared, own = text(chance, 1000), text(chance, 1000)
        alike = shared + own
        rows += [(group * 10, shared + text(chance, 1000)), (group * 10 + 1, alike), (group * 10 + 2, edited(chance, alike, 2))]
    want, links = all_pairs(rows)
    got = classes(spark, rows)
    assert len(links) >= 25 and sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links)
    assert all(want[got[i]] == want[i] for i in want)


def test_prefixes_two_levels_apart_meet(spark):
    chance = random.Random(6)
    rows = []
    for group in range(40):
        base = text(chance, 900 + 40 * group)
        rows += [(group * 10, base), (group * 10 + 1, base[: int(len(base) * 0.82)])]
    want, links = all_pairs(rows)
    got = classes(spark, rows)
    levels = [abs(int(E.seen_steps([a])[0][0]) - int(E.seen_steps([b])[0][0])) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert 2 in levels and len(links) >= 15 and sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)


def test_classes_of_the_query_with_null_ids(spark):
    chance = random.Random(7)
    base = text(chance, 800)
    rows = [(3, base), (None, base), (8, edited(chance, base, 1)), (9, text(chance, 800)), (None, text(chance, 700)), (4, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = E.with_edits_and_classes(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.class_id) for r in got if r.doc_id) == [(False, 3, 3), (False, 4, 4), (False, 8, 3), (False, 9, 9)]
    assert sorted(map(repr, (r.class_id for r in got if r.doc_id is None))) == ["3", "None"]


def test_many_rows_of_one_id_are_dealt_to_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(E, "RANGE_DOCUMENTS", 20)
    chance = random.Random(8)
    rows = [(None if i % 3 else i, text(chance, 20)) for i in range(600)] + [(300, text(chance, 20)) for _ in range(200)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = E.dealt_ranges(docs).groupBy("range").count().collect()
    assert len(ranges) >= 20 and max(r["count"] for r in ranges) <= 120


def test_a_settled_step_leaves_no_shuffle_files(spark):
    """Before any other query runs: the next step may be the one that needs the disk."""
    spark.range(10).count()
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f for d in manager.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}
    before, rows = kept(), spark.range(5000).withColumn("x", F.col("id") * 3)
    table = common.settled(lambda: rows.repartition(3, "x"), "settled-test", spark)
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before
    assert table.count() == 5000
