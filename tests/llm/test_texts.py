"""License scan, toxicity, HTML extraction and URL filter."""

import random

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from assayer.llm import catalog, html_text, license_scan, toxicity, url_filter

INDEX = license_scan.Index(license_scan.TEMPLATES)
MIT = license_scan.TEMPLATES["MIT"]


def brute_coverage(template, text):
    """Longest common subsequence of words over the template's length: what no alignment can beat."""
    a, b = ([w.lower() for w in license_scan.WORD.findall(x)] for x in (template, text))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1] / len(a)


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_is_found_where_it_stands(name):
    before = "Some words of the author, licensed or not. "
    text = before + license_scan.TEMPLATES[name] + " And more words follow here."
    found = license_scan.spans(INDEX, text)
    assert [(f[0], f[1]) for f in found] == [(name, 1.0)]
    assert found[0][3] == len(before) and text[found[0][3] : found[0][4]] == license_scan.TEMPLATES[name].rstrip(".:").rstrip("/") or name.endswith("header")


def test_changed_licenses():
    rng = random.Random(3)
    for _ in range(20):
        words = MIT.split()
        for _ in range(6):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new", words[at]], ["other"]])
        text = " ".join(words)
        (found,) = license_scan.spans(INDEX, "x y z " + text)
        assert found[0] == "MIT" and 0.8 <= found[1] <= brute_coverage(MIT, text) and found[1] >= brute_coverage(MIT, text) - 0.05


@pytest.mark.parametrize("n", [12, 20, 30, 60])
def test_words_put_in_the_middle(n):
    words = MIT.split()
    text = " ".join(["before"] * 9 + words[:44] + ["foreign"] * n + words[44:] + ["after"] * 9)
    (found,) = license_scan.spans(INDEX, text)
    assert found[:2] == ("MIT", 1.0) and text[found[3] : found[4]].split()[0] == "Permission" and found[4] > len(text) - 60


def test_two_licenses_side_by_side_with_insertions():
    words = MIT.split()
    once = [*words[:30], *["x"] * 15, *words[30:60], *["y"] * 15, *words[60:]]
    assert [f[:2] for f in license_scan.spans(INDEX, " ".join(once * 3))] == [("MIT", 1.0)] * 3


def test_every_one_of_adjacent_notices():
    line = license_scan.TEMPLATES["MIT-notice"]
    for n in (1, 2, 7, 50):
        assert len(license_scan.spans(INDEX, f"{line} " * n)) == n
    assert [f[2] for f in license_scan.spans(INDEX, f"Released under the MIT permit. {line} Released under the MIT permit. {line}")] == [4, 5, 4, 5]


def test_short_notices_with_a_changed_word():
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        # Words as the scan counts them: one of five or more may differ.
        if 5 <= len(license_scan.WORD.findall(template)) <= 15:
            for at in range(len(words)):
                if len(license_scan.WORD.findall(words[at])) == 1:
                    text = "so " + " ".join([*words[:at], "zebra", *words[at + 1 :]])
                    assert [f[0] for f in license_scan.spans(INDEX, text)][:1] == [name], text


def free_alignment(template, ids):
    """The best local alignment over all diagonals, one cell at a time: its matches."""
    best = (0, 0)
    above = [(0, 0)] * (len(ids) + 1)
    for word in template:
        row = [(0, 0)]
        for j, x in enumerate(ids, 1):
            equal = x == word
            gain = license_scan.MATCH if equal else license_scan.MISS
            cell = max((above[j - 1][0] + gain, above[j - 1][1] + equal), (above[j][0] - 1, above[j][1]), (row[-1][0] - 1, row[-1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best[1]


def test_scan_finds_what_an_alignment_without_a_band_finds():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    templates = {f"t{n}": " ".join(rng.choice(words) for _ in range(n)) for n in (4, 5, 7, 12, 30, 80)}
    index = license_scan.Index(templates)
    for _ in range(150):
        name = rng.choice(sorted(templates))
        text = templates[name].split()
        for _ in range(rng.randrange(1 + len(text) // 8)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["other"], ["more", text[at]]])
        at = rng.randrange(len(text) + 1)
        text[at:at] = [rng.choice(words) for _ in range(rng.choice([0, 0, 3, len(text) // 2]))]
        text = [rng.choice(words) for _ in range(20)] + text + [rng.choice(words) for _ in range(20)]
        ids = [index.vocabulary.get(w, 0) for w in text]
        found = {f[0]: f[2] for f in license_scan.spans(index, " ".join(text))}
        t = index.names.index(name)
        matches = free_alignment(index.words[t].tolist(), ids)
        # Words put in between may break every run that the index knows; then nothing proposes the place.
        hit = any(h[0] == t for h in index.hits(np.array(ids, np.int64)))
        if matches / len(index.words[t]) >= license_scan.COVERAGE and hit:
            assert found.get(name, 0) >= min(matches - 1, 0.9 * matches), (name, text)


def test_half_a_license_and_plain_text_are_left_alone():
    assert license_scan.spans(INDEX, MIT[: len(MIT) // 2]) == []
    assert license_scan.spans(INDEX, "The license was under the table. Version 2 of the work is released.") == []


def test_repeated_and_odd_texts(spark):
    line = license_scan.TEMPLATES["MIT-notice"]
    rows = [(1, None, "a"), (2, "", "b"), (3, f"{line}\n{line} " * 200, "c"), (4, "word " * 200000 + line, "d"), (4, "İ " + line, "d"), (None, line, "e")]
    got = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string, template string")).collect()
    assert sorted((r.doc_id or 0 for r in got)) == [0] + [3] * 400 + [4, 4]
    assert all(next(t for i, t, _ in rows if i == r.doc_id and t and len(t) >= r.span_end and t[r.span_start : r.span_end] == line.rstrip(".")) for r in got)
    assert license_scan.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled(spark, n=400):
    rng = random.Random(1)
    docs = []
    for i in range(n):
        words = [rng.choice(["table", "green", "walk", "river", "stone", "letter"]) + rng.choice("abcdef") for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["moronic", "idiotas"])
        docs.append((i, " ".join(words), i % 4 == 0))
    return spark.createDataFrame([(i, t, 0.5) for i, t, _ in docs], "doc_id long, text string, score double"), spark.createDataFrame([(i, int(y)) for i, _, y in docs], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.scored(docs, labels).withColumn("held", toxicity.held_out(F.col("doc_id"), 5, 0)).collect()
    held = [r for r in rows if r.held]
    assert len(rows) == 400 and len(held) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(900, None, 1.0), (901, "", 1.0), (902, "green " * 100000 + "moronic", 1.0), (902, "x", 1.0), (None, "y", 1.0)], docs.schema)
    messy = labels.union(labels).union(spark.createDataFrame([(1, None), (None, 1), (12345, 1)], labels.schema))
    rows = toxicity.scored(docs.union(odd), messy).filter("doc_id >= 900 or doc_id is null").collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.scored(docs, labels.limit(0)).collect()} == {1}
    assert {r.predicted for r in toxicity.scored(docs, labels.filter("toxic = 0")).collect()} == {0}


PROSE = "It was the best of times and it was the worst of times, and all of the people in the town had heard that there was to be a meeting in the hall. "


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- never closed " + PROSE, ""),
    (page(f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{PROSE}</p><p>Short.</p></article><footer>&copy; {PROSE}</footer>"), f"Head {PROSE}Short."),
    (page(f"<div class='sidebar'>{PROSE}</div><p>{PROSE}<p>{PROSE}<div id=comments><p>{PROSE}</div>"), f"{PROSE}{PROSE}"[:-1]),
    (page(f"<div class=ad>Buy the best of it now.</div><article><p>a &amp;lt; b&nbsp;&eacute;\n c<br>d {PROSE}</p></article>"), f"a &lt; b é c d {PROSE}"[:-1]),
    (page(f"<article><p>{PROSE}<script>var t='</p>'</script><b>bold</b>er<!-- x --> end</p><form><p>{PROSE}</p></form></article>"), f"{PROSE}bolder end"),
    (page("<article><p>Only a short one.</p></article>"), "Only a short one."),
    (page(f"<div class='wrap has-sidebar'><div id=content><h2>Short</h2><p>{PROSE}</p></div><div class='left-sidebar'><p>{PROSE}</p></div><div id='sidebar-2'><p>{PROSE}</p></div></div>"), f"Short {PROSE}"[:-1]),
    (page(f"<ul><li><a href=a>{PROSE}</a></li></ul><p>{PROSE}</p>"), PROSE[:-1]),
    (page(f"<p>{PROSE}</p><div class='cookie-notice'><p>{PROSE}</p></div><section class='comments'><article><p>{PROSE}</p></article></section>"), PROSE[:-1]),
])
def test_main_text(html, want):
    assert html_text.main_text(html) == want.strip()


def test_broken_and_huge_pages_end():
    assert html_text.main_text("<a \"" * 3000) == ""
    assert len(html_text.main_text(page("<p>" + PROSE * 20000))) == len(PROSE) * 20000 - 1


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", page(f"<p>{PROSE}"), "y"), (2, "u", page(f"<p>{PROSE}"), "y"), (None, None, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extracted(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(PROSE) - 1, len(PROSE) - 1] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(df.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://a.org/x", "http://A.Example.ORG/es/1?q=/en/1", "http://example.org/en/12", "http://notexample.org/es/", "x://fr.com/fr/", "https://de.com/de/#a", "http://org", "http://a.net/en/😀",
        "://org/", "http://b.com/es/1", "http://b.com/es/1", "http://user@h.net:80/p://q", "http://c.net\n/x", "http://" + "long/" * 4000]


def test_urls(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "verdict", "rule") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string, rule string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    rows = {r.page_id: r for r in url_filter.query(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 * len(URLS) and {r.verdict for r in rows.values()} <= {"allow", "block"}
    assert [rows[i].rule for i in (3, 4, 5, 6, 7, 8, 9)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None]
    assert (rows[4].host, rows[4].path) == ("a.example.org", "/es/1") and (rows[0].host, rows[0].path) == ("", "") and rows[11].rule == "org/"
    assert all(rows[i].verdict == rows[i + len(URLS)].verdict for i in range(len(URLS)))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same_rows(url_filter.query(spark, str(tmp_path)), con, url_filter.ORACLE_SQL)


def test_urls_of_one_kind_or_none(spark):
    assert url_filter.judged(spark.createDataFrame([], "url string")).count() == 0
    assert {r.verdict for r in url_filter.judged(spark.createDataFrame([("http://a.net/",)] * 3, "url string")).collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    from conftest import SMALL

    same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])
