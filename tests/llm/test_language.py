"""Language evidence against the same sums made row by row."""

import numpy as np
import pytest

from lectern.llm import language

TEXTS = {
    "en": "the house of the king was built with stone and the river ran under the bridge",
    "de": "das haus des königs wurde aus stein gebaut und der fluss lief unter der brücke",
    "fr": "la maison du roi était bâtie en pierre et la rivière passait sous le pont",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(" ".join(t.split()[i % 5 :] + t.split()[: i % 7]), lang.upper() + " ") for lang, t in TEXTS.items() for i in range(20)]
    rows += [(None, "en"), ("nothing", None), ("nothing", "")]
    return language.fit_text_model(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")


def evidence(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, declared string, host string, language string")


def brute(rows, model):
    """Probability of each language for each row."""
    size = len(model.languages)
    logs, counts = model.log_likelihoods([r[1] or "" for r in rows])
    post = np.exp(logs - logs.max(axis=1, keepdims=True))
    post /= post.sum(axis=1, keepdims=True)
    some = counts > 0
    overall = (post[some].sum(axis=0) + 1) / (some.sum() + size)

    def told(d):
        import re

        return (re.match("[a-z]+", (d or "").strip().lower()) or [None])[0]

    def level(part, value):
        return sum((post[i] for i, r in enumerate(rows) if some[i] and r[3] and part(r[3]) == value), np.zeros(size))

    def smooth(c, parent):
        return (c + language.PARENT_ROWS * parent) / (c.sum() + language.PARENT_ROWS)

    def domain(h):
        return ".".join(h.lower().split(".")[-2:])

    def suffix(h):
        return h.lower().split(".")[-1]

    declared = [told(r[2]) for r in rows]
    by = {d: sum((post[i] for i in range(len(rows)) if some[i] and declared[i] == d), np.zeros(size)) for d in set(declared) if d}
    totals = sum(by.values(), np.zeros(size))
    out = []
    for i, (_, _, _, host) in enumerate(rows):
        prior = overall
        if host and some[i]:
            parent = smooth(level(domain, domain(host)), smooth(level(suffix, suffix(host)), overall))
            prior = smooth(np.maximum(level(str.lower, host.lower()) - post[i], 0), parent)
        log = logs[i] + np.log(prior)
        if declared[i] in by and by[declared[i]].any():
            belief = [language.TRUSTED if declared[i] == x else (1 - language.TRUSTED) / size for x in model.languages]
            log += np.log((by[declared[i]] + language.DECLARED_ROWS * np.array(belief)) / (totals + language.DECLARED_ROWS))
        p = np.exp(log - log.max())
        out.append(p / p.sum() if some[i] else None)
    return out


def test_equal_to_sums_row_by_row(spark, model):
    rows = []
    for i in range(60):
        lang = list(TEXTS)[i % 3]
        text = " ".join(TEXTS[lang].split()[i % 6 : i % 6 + 1 + i % 9])
        rows.append((i, text, [lang, lang.upper() + "-x", None, "xx", ""][i % 5], [f"www.{lang}.example.{lang}", "Mixed.Host.org", None, f"a{i}.example.de"][i % 4]))
    rows += [(100, None, "en", "h.org"), (101, "", None, None), (102, "123 $$$", "de", "h.org"), (103, "the " * 20_000, None, None), (None, "das haus", "de", "h.de")]
    rows += [(104, "le roi", "fr", "h.fr")] * 3
    got = language.identified(evidence(spark, rows), model, ["doc_id", "text", "declared", "host"], "text", "declared", "host").collect()
    assert len(got) == len(rows)
    want = {r: p for r, p in zip(rows, brute(rows, model))}
    for r in got:
        p = want[r.doc_id, r.text, r.declared, r.host]
        if p is None:
            assert (r.language, r.probability, r.accepted) == ("und", 0.0, False)
        else:
            assert abs(r.probability - p.max()) < 1e-9 and r.language == model.languages[int(p.argmax())]


def test_text_of_no_known_language_is_rejected(spark, model):
    rows = [(1, "zxqj vkwq xzzq jjqx qvvk zzkx wqxj kkvz " * 5, None, None), (2, TEXTS["de"], None, None)]
    got = {r.doc_id: r for r in language.identified(evidence(spark, rows), model, ["doc_id"], "text", "declared", "host").collect()}
    assert got[1].language == "und" and not got[1].accepted and got[2].language == "de" and got[2].accepted


def test_host_decides_a_short_text(spark, model):
    rows = [(i, TEXTS["fr"], None, "fr.example.com") for i in range(30)] + [(100, "pont", None, "fr.example.com"), (101, "pont", None, None)]
    got = {r.doc_id: r for r in language.identified(evidence(spark, rows), model, ["doc_id"], "text", "declared", "host").collect()}
    assert got[100].language == "fr" and got[100].probability >= got[101].probability


def test_page_evidence(spark):
    rows = [
        ('<html class=a lang="de-AT"><script>x</p></script><p>Haus&nbsp;und</p><!-- no -->Hof', "https://u@Sub.Example.de:80/en/?q"),
        ("plain", "nothing"), (None, None), ("<HTML lang=fr>", "http://h"),
    ]
    df = spark.createDataFrame(rows, "html string, url string")
    got = df.select(*(c.alias(n) for n, c in language.page_evidence(df.html, df.url).items())).collect()
    assert [(r.text and r.text.split(), r.declared, r.host) for r in got] == [
        (["Haus", "und", "Hof"], "de-AT", "Sub.Example.de"), (["plain"], "", None), (None, None, None), ([], "fr", "h"),
    ] or [(r.text and r.text.split(), r.declared, r.host) for r in got][3][0] in ("", [], " ")


def test_rare_languages_stay_known_and_copies_count_once(spark):
    rows = [(f"{TEXTS['en']} {i}", "en") for i in range(3000)] + [(TEXTS["de"], "de"), (TEXTS["fr"], "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    few = language.fit_text_model(df, "text", "lang", max_rows=30)
    assert few.languages == ["de", "en", "fr", "und"]
    copied = language.fit_text_model(df.unionByName(df.where("lang = 'de'").crossJoin(spark.range(500)).drop("id")), "text", "lang", max_rows=30)
    assert np.array_equal(few.chances, copied.chances)
    # The bound is of each language's distinct texts.
    some = np.exp(few.chances[1])
    taken = 0.5 / some.min() / len(language.trigrams([TEXTS["en"]])[0])
    assert 5 < taken < 400


def test_no_rows(spark, model):
    assert language.identified(evidence(spark, []), model, ["doc_id"], "text", "declared", "host").count() == 0
    empty = language.fit_text_model(evidence(spark, []), "text", "language")
    assert empty.languages == ["und"]
    assert language.identified(evidence(spark, [(1, "text", "en", "h")]), empty, ["doc_id"], "text", "declared", "host").first().language == "und"
