"""Near-duplicates against all pairs, and components against union-find."""

import random
import re

import pytest

from lectern.llm import near_dups
from lectern.llm.graph import components


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, width, percent):
    sets = {i: sets_of(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in roots(ids, links).items()}


def check(spark, rows, width=4, percent=80):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = near_dups.near_duplicates(df, width, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def changed(chance, words, share):
    return [chance.choice("abcdefghij") * 3 if chance.random() < share else w for w in words]


def corpus(seed, hot=0):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = chance.choices(vocabulary, k=chance.randint(3, 120))
        for share in chance.sample([0, 0.01, 0.02, 0.03, 0.05, 0.1], chance.randint(1, 4)):
            rows.append(" ".join(changed(chance, base, share)))
    base = chance.choices(vocabulary, k=80)
    rows += [" ".join(changed(chance, base, 0.03)) for _ in range(hot)]
    chance.shuffle(rows)
    return list(enumerate(rows))


def test_random_documents(spark):
    check(spark, corpus(1))


def test_a_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_CLASSES", 16)
    check(spark, corpus(2, hot=150))


def test_ids_may_be_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    check(spark, corpus(3, hot=20))


def test_nulls_copies_short_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "one two three four"), (8, "One two\nthree four")]
    rows += [(9, long), (10, long + " y"), (11, "é à"), (12, "É à"), (13, "a\x0bb\x1cc d e"), (14, "A b\x1cc\x0cd E")]
    rows += [(20 + i, "same text for all of these rows here") for i in range(50)] + [(30, "same text for all of these rows here")] * 3
    rows += [(None, "same text for all of these rows here"), (None, None)]
    check(spark, rows)


def test_five_words_by_default(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles) for r in near_dups.near_duplicates(df).collect()} == {(1, 2), (2, 2), (3, 1)}


def test_no_rows(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_matches_keep_what_they_promise():
    chance = random.Random(5)
    bounds = near_dups.least_matches(0.8)
    lost = 0
    for _ in range(3000):
        hits = [chance.random() < 0.8 for _ in range(near_dups._HASHES)]
        lost += any(sum(hits[:n]) < least for n, least in bounds)
    assert lost <= 2 and bounds[-1][1] > 80


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    chance = random.Random(6)
    links = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(77, i) for i in range(60)] + [(5, 100), (100, 101)],
        "random": [tuple(chance.sample(range(150), 2)) for _ in range(90)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({n for link in links for n in link}, links)
