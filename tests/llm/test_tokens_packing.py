"""Token counts and packing against the libraries and a document-by-document packer."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import common, packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "line\nends\r\n\n\ttabs", "no break space\x1cfile", "ΑΣ ΟΔΟΣ. ΣΑΣ",
    "x<|endoftext|>y <|startoftext|> z", "é café 中文字 \U0001f600 naïve", "don't I'LL we're", "1234 5,6.7 $$$ %%%",
    "word " * 5000, "q" * 30_000, "ab\x00cd", "﻿mark",
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_equal_the_library(spark, path):
    library = Tokenizer.from_file(path)
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(1, "again", "n"), (1, "again", "n"), (None, "null id", "n")]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, 10).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((*w, w[2] > 10) for w in want)


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:12])], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, PIECES).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(TEXTS[:12])}


def test_counts_of_no_rows(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


@pytest.mark.parametrize("frequent,held,slice_chars", [(3, 2, 10), (0, 10**6, 10**6), (10**6, 5, 50)])
def test_rare_pre_tokens_are_joined(spark, monkeypatch, frequent, held, slice_chars):
    """Whatever part of the pre-tokens goes to the texts, the others come from their table."""
    monkeypatch.setattr(tokens, "FREQUENT", frequent)
    monkeypatch.setattr(tokens, "HELD", held)
    monkeypatch.setattr(common, "SLICE_CHARS", slice_chars)
    library = Tokenizer.from_file(WORDS)
    chance = random.Random(3)
    words = [f"w{n}" * chance.randrange(1, 4) for n in range(50)]
    rows = [(i % 70, " ".join(chance.choices(words, k=chance.randrange(40)))) for i in range(150)] + list(enumerate(TEXTS)) + [(None, "w1 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(df, WORDS).collect())
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_each_distinct_pre_token_is_counted_once(spark):
    df = spark.createDataFrame([(i, f"same words again {i % 7}") for i in range(100)], "id long, text string").repartition(5)
    table = tokens.piece_table(df.select("id", "text"), WORDS).collect()
    assert {r.piece: r.uses for r in table} == {"same": 100, "words": 100, "again": 100} | {str(n): len(range(n, 100, 7)) for n in range(7)}
    assert len(table) == 10 and all(r.n >= 1 for r in table)


def test_every_token_of_the_ranks_encodes_to_itself():
    """With this, merging by rank and merging by the list of merges give the same ids."""
    library = Tokenizer.from_file(BYTES)
    assert all(len(library.model.tokenize(t)) == 1 for t, i in library.get_vocab().items() if i < 50_256)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=80))
def test_ids_from_ranks_equal_the_library(text):
    encoder = packing._known(BYTES, RANKS)
    assert list(next(iter(encoder.encode([text])))) == encoder.library.encode(text, add_special_tokens=False).ids


def brute_sequences(lengths, capacity):
    """Best fit decreasing, one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda j: rooms[j])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120))
def test_plan_is_best_fit(lengths):
    runs = packing.plan_slots(dict(Counter(lengths)), 30)
    spans = {}
    for length, low, high, first, each, offset in runs:
        for rank in range(low, high):
            spans.setdefault(first + (rank - low) // each, []).append((offset + (rank - low) % each * length, length))
    assert sum(map(len, spans.values())) == len(lengths)
    for held in spans.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
        assert held[-1][0] + held[-1][1] <= 30
    assert len(spans) == brute_sequences(lengths, 30)


def test_packed_documents(spark):
    library = Tokenizer.from_file(BYTES)
    texts = [*TEXTS, *(" ".join(random.Random(i).choices(["the", "of", "stone", "river\n"], k=i * 7)) for i in range(60))]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, "a", 5)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(3)
    got = packing.packed_documents(df, BYTES, RANKS, capacity=64).toPandas()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert list(held.offset) == [0, *np.cumsum(held.length)[:-1]] and held.length.sum() <= 64
    assert got.sequence_id.nunique() == brute_sequences(got.length, 64)


def test_packing_of_no_rows(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), BYTES, RANKS).count() == 0
