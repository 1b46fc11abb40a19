"""Captured pages as a data source, mapped to one shape, and cleaned markup."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from paperweave.functions import text
from paperweave.sources import captured, mappings, readers

EUROPE = {
    "resultList": {"result": [
        {"id": "123", "source": "PMC", "doi": "10.1/A", "title": "CO<sub>2</sub> &amp; more", "pubYear": "2021", "citedByCount": 7, "authorList": {"author": [{"fullName": "Ann B"}, {"x": 1}]}, "isOpenAccess": "Y",
         "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "S", "url": "https://a.org/s"}, {"availabilityCode": "OA", "documentStyle": "html", "url": "https://a.org/h"}, {"availabilityCode": "OA", "documentStyle": "PDF", "url": "https://a.org/p"}]}},
        {"id": "9", "title": ["a list"], "citedByCount": "many"},
    ]}
}
CROSSREF = {"message": {"items": [
    {"DOI": "10.2/B", "title": ["First", "Second"], "container-title": "Journal", "issued": {"date-parts": [[2020, 5]]}, "published-print": {"date-parts": [[None]]}, "ISSN": ["1234567X", "1234-567X"], "is-referenced-by-count": 3,
     "author": [{"given": "Bo", "family": "Li"}, {"name": "Group"}], "license": [{"URL": "https://creativecommons.org/by/4.0"}], "link": [{"URL": "http://b.org/x.pdf", "content-type": "unspecified"}], "URL": "https://doi.org/10.2/B"},
]}}
DOAJ = {"results": [{"id": "d1", "bibjson": {"title": "T", "year": "2019", "month": "7", "identifier": [{"type": "DOI", "id": "10.3/C"}, {"type": "eissn", "id": "2049-3630"}], "journal": {"title": "J", "issn": "20493630"}, "author": [{"name": "C"}], "link": [{"type": "fulltext", "url": "https://c.org/a.pdf"}]}}]}


@pytest.fixture
def folder(tmp_path):
    path = str(tmp_path / "pages")
    for source, body in (("europe_pmc", EUROPE), ("crossref", CROSSREF), ("doaj", DOAJ)):
        captured.write_page(path, source, "2024-01-01", 1, body)
    captured.write_page(path, "crossref", "2024-02-01", 2, "no JSON {")
    captured.write_page(path, "doaj", "2024-03-01", 1, {"results": "none"})
    return path


def test_filters_choose_folders(spark, folder):
    captured.register(spark)
    pages = spark.read.format("captured_pages").option("path", folder).load()
    assert pages.count() == 5
    some = pages.filter((F.col("source") == "crossref") & (F.col("captured") >= datetime.date(2024, 1, 15)))
    assert [(r["source"], str(r["captured"]), r["body"]) for r in some.collect()] == [("crossref", "2024-02-01", "no JSON {")]
    load = lambda: spark.read.format("captured_pages").option("path", folder).load()
    both = load().filter("source = 'doaj'").union(load().filter("source = 'europe_pmc'"))
    assert sorted(r["source"] for r in both.collect()) == ["doaj", "doaj", "europe_pmc"]
    reader = captured._Batch(folder)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    rest = list(reader.pushFilters([EqualTo(("source",), "crossref"), GreaterThanOrEqual(("captured",), datetime.date(2024, 1, 15)), StringContains(("body",), "x")]))
    assert len(rest) == 1 and [p.paths for p in reader.partitions()] == [(f"{folder}/crossref/2024-02-01/00000002.json",)]
    assert spark.read.format("captured_pages").option("path", folder + "/none").load().count() == 0


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    captured.register(spark)

    def run():
        stream = spark.readStream.format("captured_pages").option("path", folder).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["source"], r["page"], str(r["captured"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 5
    captured.write_page(folder, "doaj", "2024-03-01", 2, DOAJ)
    second = run()
    assert len(second) == 6 and set(first) < set(second)
    assert run() == second


def test_pages_become_hits_of_one_shape(spark, folder):
    captured.register(spark)
    hits = mappings.captured_hits(spark.read.format("captured_pages").option("path", folder).load())
    want = spark.createDataFrame([], readers.HIT).schema
    assert hits.schema.simpleString() == want.simpleString()
    got = {r["id"]: r for r in hits.collect()}
    assert set(got) == {"europepmc:PMC:123", "europepmc:unknown:9", "crossref:10.2/b", "doaj:d1"}
    e, c, d = got["europepmc:PMC:123"], got["crossref:10.2/b"], got["doaj:d1"]
    assert (e["title"], e["publication_date"], e["cited_by_count"], e["open_access"], e["primary_location"]["landing_page_url"]) == ("CO₂ & more", "2021-01-01", 7, (True, "https://a.org/p"), "https://a.org/h")
    assert [a["author"]["display_name"] for a in e["authorships"]] == ["Ann B"] and got["europepmc:unknown:9"]["cited_by_count"] is None
    assert (c["title"], c["publication_date"], c["publication_year"], c["primary_location"]["source"], c["open_access"]["is_oa"]) == ("First", "2020-05-01", "2020", ("Journal", ["1234-567X"], "1234-567X"), True)
    assert [a["author"]["display_name"] for a in c["authorships"]] == ["Bo Li", "Group"] and c["primary_location"]["pdf_url"] == "https://b.org/x.pdf"
    assert (d["doi"], d["publication_date"], d["primary_location"]["source"]["issn"], d["open_access"]) == ("10.3/C", "2019-07-01", ["2049-3630"], (True, "https://c.org/a.pdf"))
    records = {r["title"]: r for r in readers.to_records(hits).collect()}
    assert records["First"]["record_key"] and records["T"]["year"] == 2019 and records["CO₂ & more"]["is_open"]


def test_markup(spark):
    cases = {
        "H<sub>2</sub>O and x<sup>n</sup>": "H₂O and xⁿ",
        "<p>One&nbsp;two</p><p>three &lt;b&gt;four&lt;/b&gt;</p>": "One two three four",
        "Na <sub>2</sub> S <sub>x</sub>": "Na₂Sₓ",
        "<scp>S</scp> n <scp>S</scp> e": "Sn Se",
        "MX ene films , good !": "MXene films, good!",
        "10 <sup> -3 </sup> mol / L": "10⁻³ mol/L",
        "a <sub><i>1</i>+</sub>": "a₁₊",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert [(r["t"], r["got"]) for r in df.select("t", text.clean_markup(F.col("t")).alias("got")).collect()] == list(cases.items())
    assert json.loads(json.dumps(text.plain_markup("&#8211; &eacute;"))) == "–é"
