"""Repeated units against a plain pass over the documents in order."""

import random
import re
import zlib
from pathlib import Path

from lectern.llm import substrings
from lectern.llm.substrings import Units


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string").repartition(3)


def brute(rows):
    """Text by (id, text): units already seen in an earlier text or place go, as the operator's rules say."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        units = Units([text or ""])
        again = []
        for n, digest in enumerate(units.digest.tolist()):
            if digest in seen:
                again.append(n)
            seen.add(digest)
        spans = substrings._spans(units, 0, text or "", units.removed(0, again)) if again else []
        ends, begins = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text or "")]
        out[i, text] = (None if text is None else "".join(text[a:b] for a, b in zip(ends, begins)), [(a, b - a) for a, b in spans])
    return out


def check(spark, rows):
    want = brute(rows)
    got = substrings.without_repeats(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for (i, _), result in want.items():
        by_id.setdefault(i, []).append(result)
    for r in got:
        assert (r.text, [tuple(s) for s in r.removed]) in by_id[r.doc_id]
    return got


def words(chance, n):
    return " ".join(chance.choice("abcdefghijklm") + str(chance.randrange(10_000)) for _ in range(n))


def test_passages_lines_and_offsets(spark):
    chance = random.Random(1)
    passage = ". ".join(words(chance, 9) for _ in range(7)) + "."
    bare = words(chance, 70)
    line, short = words(chance, 12), "Home | About"
    rows = [(i, f"{words(chance, 20)}. {words(chance, 5)} {passage if i % 3 == 0 else bare} {words(chance, 6)}.\n{line}\n{short}\né {words(chance, 8)}") for i in range(12)]
    clean = [(100 + i, ". ".join(words(chance, 8) for _ in range(6))) for i in range(20)]
    got = {r.doc_id: r for r in check(spark, rows + clean)}
    for i, text in clean:
        assert got[i].text == text and not got[i].removed
    assert passage in got[0].text and sum(line in r.text for r in got.values()) == 1
    inner = ". ".join(passage.split(". ")[1:6])
    assert not any(inner in got[i].text for i in range(3, 12, 3))
    middle = " ".join(bare.split()[20:50])
    assert not any(middle in got[i].text for i in range(2, 12) if i % 3)
    assert all(short in got[i].text for i in range(12))


def test_passages_alone_and_set_into_others_go_whole(spark):
    chance = random.Random(5)
    rows, want = [], {}
    for n in range(30):
        size = 51 + n % 10
        bare = words(chance, size)
        thirds = [" ".join(bare.split()[i : i + 18]) + "." for i in range(0, 54, 18)]
        passage = [bare, " ".join(thirds), bare.replace(" ", "\n", 1)][n % 3]
        before, after = words(chance, 13), words(chance, 13)
        alone, inside = (2 * n, 2 * n + 1) if n % 2 else (2 * n + 1, 2 * n)
        rows += [(alone, passage), (inside, f"{before} {passage} {after}")]
        want[alone], want[inside] = ("", f"{before} {passage} {after}") if inside < alone else (passage, f"{before}  {after}")
    got = {r.doc_id: r.text for r in check(spark, rows)}
    assert got == want


def test_scripts_without_spaces(spark):
    chance = random.Random(6)
    han = lambda n: "".join(chr(chance.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage, few = han(60), han(30)
    rows = [(1, han(9) + passage + han(7)), (2, (a := han(50)) + passage + (b := han(40))), (3, c := han(20) + few + han(20)), (4, d := han(20) + few)]
    assert {r.doc_id: r.text for r in check(spark, rows)} == {1: rows[0][1], 2: a + b, 3: c, 4: d}


def test_the_first_of_overlapping_runs_stays(spark):
    got = {r.doc_id: r.text.split() for r in check(spark, [(1, "long " * 500), (2, "a b c " * 100)])}
    assert got[1] == ["long"] * 20 and got[2][:20] == ("a b c " * 7).split()[:20] and len(got[2]) <= 23


def test_null_ids_are_told_apart_by_more_than_a_checksum(spark):
    # These two texts have the same CRC-32.
    line = words(random.Random(7), 14)
    low, high = "plumless", "buckeroo"
    assert zlib.crc32(low.encode()) == zlib.crc32(high.encode())
    rows = [(0, line), (None, f"{low}"), (None, f"{high}")]
    assert {r.text for r in check(spark, rows)} == {line, low, high}
    tail = f"\n{line}\nzebra {line[::-1]}"
    assert zlib.crc32((low + tail).encode()) == zlib.crc32((high + tail).encode())
    got = [r.text for r in substrings.without_repeats(documents(spark, [(None, low + tail), (None, high + tail)])).collect()]
    assert sum(line in t for t in got) == 1


def test_rank_edges_and_repeated_rows(spark):
    chance = random.Random(2)
    passage = ". ".join(words(chance, 10) for _ in range(4)) + "."
    rows = [(5, passage), (3, passage), (9, f"x\n{passage}\ny"), (None, passage), (1, None), (2, ""), (4, " \n\n")]
    rows += [(7, f"{passage}\n{passage}")] * 3 + [(8, "long " * 40_000), (11, "long " * 40_000), (12, "E. " * 30)]
    got = check(spark, rows)
    assert [r.text for r in got if r.doc_id == 3] == [passage]
    assert [r.text for r in got if r.doc_id == 5] == [""] and [r.text for r in got if r.doc_id == 9] == ["x\ny"]
    assert {r.text for r in got if r.doc_id == 1} == {None}


def test_normalised_case_and_spaces(spark):
    chance = random.Random(3)
    line = words(chance, 15)
    got = check(spark, [(1, line), (2, line.upper().replace(" ", "  \t"))])
    assert {r.doc_id: r.text for r in got} == {1: line, 2: ""}


def test_units_cover_each_word_once():
    chance = random.Random(4)
    texts = ["", "a", words(chance, 200), "x. y! z?\n\n  q", "w " * 300]
    units = Units(texts)
    for n in range(len(texts)):
        held = [(a, b) for a, b, t, is_line in zip(units.low, units.high, units.text, units.line) if t == n and not is_line]
        low, high = units.words.first[n], units.words.first[n + 1]
        assert [i for a, b in held for i in range(a, b)] == list(range(low, high))


def test_no_rows(spark):
    assert substrings.without_repeats(documents(spark, [])).count() == 0


def plain(rows):
    """The rules on word tuples, without any code of the module: what stays of each (id, text)."""
    seen, out = set(), {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in sorted(set(rows)):
        found = [(m.start(), m.end(), m.group().translate(lower)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        runs = [tuple(w for *_, w in found[n : n + 20]) for n in range(len(found) - 19)]
        again = []
        for n, run in enumerate(runs):
            if ("run", run) in seen:
                again.append(n)
            seen.add(("run", run))
        goes = {w for n in again for w in range(n, n + 20)}
        for n in again:  # alike and overlapping: the first stays whole
            for m in range(max(0, n - 19), n):
                if runs[m] == runs[n] and m not in again:
                    goes -= set(range(m, m + 20))
        lines, start = [], 0
        for n in range(len(found)):
            if n + 1 == len(found) or "\n" in text[found[n][1] : found[n + 1][0]]:
                lines.append(range(start, n + 1))
                start = n + 1
        for line in lines:
            key = ("line", tuple(found[n][2] for n in line))
            if len(line) >= 10:
                if key in seen:
                    goes |= set(line)
                seen.add(key)
        left, at, n = [], 0, 0
        while n < len(found):
            if n not in goes:
                n += 1
                continue
            m = n
            while m in goes:
                m += 1
            begin, stop = found[n][0], found[m - 1][1]
            if (begin == 0 or text[begin - 1] == "\n") and text[stop : stop + 1] == "\n":
                stop += 1
            left.append(text[at:begin])
            at, n = stop, m
        out[i, text] = "".join(left) + text[at:]
    return out


def test_equals_the_rules_on_word_tuples(spark):
    chance = random.Random(7)
    passages = [words(chance, n) for n in (19, 20, 21, 35, 60)]
    lines = [words(chance, n) for n in (9, 10, 14)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(chance.randrange(1, 6)):
            pick = chance.randrange(4)
            if pick == 0:
                parts.append(chance.choice(passages).upper() if chance.random() < 0.2 else chance.choice(passages))
            elif pick == 1:
                parts.append("\n" + chance.choice(lines) + "\n")
            elif pick == 2:
                parts.append(words(chance, chance.randrange(1, 30)))
            else:
                cut = chance.choice(passages[2:]).split()
                low = chance.randrange(len(cut))
                parts.append(" ".join(cut[low : low + chance.randrange(5, 40)]))
        rows.append((i, " ".join(parts)))
    rows += [(100, "ha " * 60), (101, "ha " * 25 + "end"), rows[3]]
    want = plain(rows)
    got = substrings.without_repeats(documents(spark, rows)).collect()
    before = dict(rows)
    assert {(r.doc_id, r.text) for r in got} == {(i, left) for (i, _), left in want.items()}
    assert sum(r.text != before[r.doc_id] for r in got) > 30


def test_columns_of_any_name_stay(spark):
    line = "one line of more than ten words that comes again and again here"
    docs = spark.createDataFrame(
        [(1, line, "k1", 7, [1], 0.5, "x"), (2, line + "\nmore", "k2", 8, None, 1.5, "y")],
        "doc_id long, text string, _key string, _version int, _again array<int>, `a.b` double, c0 string",
    )
    got = substrings.without_repeats(docs)
    assert got.columns == [*docs.columns, "removed", "original_chars"]
    rows = {r.doc_id: r.asDict() for r in got.collect()}
    assert (rows[1]["text"], rows[2]["text"]) == (line, "more")
    assert [rows[2][c] for c in docs.columns[2:]] == ["k2", 8, None, 1.5, "y"]


def test_only_the_last_steps_table_is_left(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.iterdir())
    rows = [(i, words(random.Random(i % 5), 40)) for i in range(30)]
    assert substrings.without_repeats(documents(spark, rows)).where("size(removed) > 0").count() == 25
    assert [p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before] == ["repeats-by-text"]
