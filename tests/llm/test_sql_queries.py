"""Queries that DuckDB can run too, and their edge cases."""

import textwrap
from pathlib import Path

import duckdb
import pytest
from contrail.llm import license_scan as licenses
from contrail.llm import queries
from contrail.llm.url_filter import filter_urls, with_host_and_path

from pyspark.sql import functions as F

from ..conftest import DATA
from .helpers import documents


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    found = [tuple(r[c] for c in expected.columns) for r in queries.queries()[name](spark, DATA).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected.fetchall()))


def test_licenses(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    whole = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    texts = [None, "", "Copyright (c) 2020 Someone\n\n" + whole.upper().replace(" ", "\n"), whole.replace("sublicense", "sublicence") + "  ", whole + " extra", "x\nReleased under the MIT Licence\ny", "(c) 2020 me", mit, "z " * 50_000]
    rows = sorted(licenses.license_scan(documents(spark, [*texts, "dup", "dup"], ids=[*range(len(texts)), 50, 50])).collect(), key=lambda r: r.doc_id)
    assert [r.license for r in rows] == [None, None, "MIT", "MIT", None, None, None, "MIT", None, None, None]
    assert [r.notices for r in rows][4:7] == ["", "MIT", ""]
    assert rows[0].digest == rows[1].digest == rows[6].digest
    assert licenses.license_scan(documents(spark, ["a"]).where("false")).count() == 0


def test_whole_licences_however_they_are_wrapped(spark):
    folder = Path("/usr/share/common-licenses")
    texts = [(n, (folder / f).read_text("latin-1")) for n, f in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("BSD-3-Clause", "BSD")) if (folder / f).exists()]
    isc = next(t for n, t in licenses.KNOWN if n == "ISC" and t.startswith("Permission"))
    texts.append(("ISC", "Copyright (c) 2020, A Holder <a@b.c>\n" + "\n".join(textwrap.wrap(isc, 72)).replace("the above\n", "the above ").replace("above copyright", "above\ncopyright")))
    joined = [(n, "\n\n".join(" ".join(p.split()) if "OPYRIGHT (" not in p else p for p in t.upper().split("\n\n"))) for n, t in texts]
    found = {r.doc_id: r.license for r in licenses.license_scan(documents(spark, [t for _, t in texts + joined])).collect()}
    assert [found[i] for i in range(2 * len(texts))] == [n for n, _ in texts] * 2
    own = licenses.digests_of(spark.createDataFrame([("OWN-1", "Do as you like,\nbut\ncopyright notices stay.")], "license string, text string"))
    rows = licenses.license_scan(documents(spark, ["do as you like but copyright\nNotices stay", "do as you like"]), own).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["OWN-1", None]
    assert "copyright owner" in spark.range(1).select(licenses.canonical_line(F.lit("Copyright owner"))).first()[0]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string").drop("host")


def test_host_and_path(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.Example.COM/En/x?q#f", "x://h?y/z", "x://h#y/z", "x://h", "a://b/c://d/e", "http://É.com/"]
    rows = [(r.host, r.path) for r in with_host_and_path(pages_of(spark, urls)).orderBy("page_id").collect()]
    assert rows == [("", "")] * 3 + [("a.example.com", "/En/x"), ("h", ""), ("h", ""), ("h", ""), ("b", "/c://d/e"), ("É.com", "/")]


def test_rules(spark):
    urls = ["http://a.com/x", "http://com", "http://www.example.com/en/1", "http://m.example.com/en/1", "http://example.com/en/", "http://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://x.net/en/", None]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = sorted(filter_urls(pages_of(spark, urls), labels).collect(), key=lambda r: r.page_id)
    assert [(r.rule, r.verdict) for r in rows] == [
        ("com/", "allow"), (None, "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("example.com/en/", "block"), ("com/", "allow"),
        ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]


def test_bad_branch_is_rejected_and_variables_are_generalised(spark):
    urls = [f"https://site.org/spam/{i}" for i in range(60)] + [f"https://site.org/news/{i + 100}" for i in range(60)] + [f"https://site.org/u{i}/{i + 300}/a/b/c/d" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(60)] + [(i, 1, 0) for i in range(100, 160)] + [(500, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = sorted(filter_urls(pages_of(spark, urls + urls[:1]), labels).collect(), key=lambda r: r.page_id)
    assert {(r.template, r.verdict) for r in rows[:60]} == {("/spam/{n}", "block")}
    assert {(r.template, r.verdict) for r in rows[60:120]} == {("/news/{n}", "allow")}
    assert {(r.template, r.verdict) for r in rows[120:180]} == {("/*/{n}/a/b/**", "allow")}
    assert rows[180][1:] == rows[0][1:]
    assert filter_urls(pages_of(spark, urls).where("false"), labels).count() == 0


def test_sparse_hosts_are_judged_by_the_hosts_beside_them(spark):
    urls = [f"https://h{i}.bad.org/x/{i}" for i in range(30)] + [f"https://h{i}.good.org/x/{i + 100}" for i in range(30)] + ["https://new.bad.org/x/900", "https://new.good.org/x/901", "https://other.net/x/902"]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    rows = sorted(filter_urls(pages_of(spark, urls), labels).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in rows[60:]] == ["block", "allow", "allow"]


def test_long_urls_other_columns_and_repeated_ids(spark):
    rows = [(1, "https://a.org/" + "s/" * 60 + "x" * 50_000, "own"), (1, "https://b.org/2024-05-12/deadbeef01/123e4567-e89b-12d3-a456-426614174000/7.html", "own"), (1, "https://b.org/2024-05-12/deadbeef01/123e4567-e89b-12d3-a456-426614174000/7.html", "own"), (None, "https://b.org", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_urls(pages, labels).collect()
    assert len(found) == 4 and sum(r.template == "/{date}/{hex}/{uuid}/{n}.html" or r.template == "/{date}/{hex}/{uuid}/**" for r in found) == 2


def test_branches_that_part_deep_down_are_told_apart(spark):
    urls = [f"https://site.org/a/b/c/d/e/{kind}/{i + first}/" for kind, first in (("spam", 0), ("news", 100)) for i in range(60)]
    urls += [f"https://site.org/a/b/c//d/{kind}/{i + first}" for kind, first in (("ads", 0), ("art", 100)) for i in range(60)] + ["https://site.org/a/b/c/d", "https://site.org/a/b/c/d/e", "https://site.org/"]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(60)] + [(i, 1, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    rows = sorted(filter_urls(pages_of(spark, urls), labels).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in rows[:240]] == (["block"] * 60 + ["allow"] * 60) * 2
    assert [r.template for r in rows[:120:60]] == ["/a/b/c/d/e/spam/{n}", "/a/b/c/d/e/news/{n}"]
    assert [(r.template, r.verdict) for r in rows[240:242]] == [("/a/b/c/d", "allow"), ("/a/b/c/d/e", "allow")]
