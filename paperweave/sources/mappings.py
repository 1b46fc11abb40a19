"""Result pages of several search services, as JSON whose shape drifts, to one shape of hits (see readers.HIT).

A page is parsed once to a variant; each service has one table of what its
fields are called, and typed reads that give null for another shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import clean_markup

#: Where the results of a page are (fixed values).
ITEMS = {"europe_pmc": "$.resultList.result", "crossref": "$.message.items", "doaj": "$.results"}
#: Dates of a Crossref result in order of preference (fixed values).
DATES = ("published-print", "published-online", "published", "issued", "created")
#: Parts of an address of an open licence (fixed values).
OPEN = ("creativecommons.org", "openaccess", "open-access", "publicdomain", "cc0")

VENUE = "struct<display_name:string,issn:array<string>,issn_l:string>"


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _first(path: str) -> Column:
    """The first text of a list, or the text that stands there instead."""
    return F.coalesce(F.get(_at(path, "array<string>"), F.lit(0)), F.when(_at(path, "array<string>").isNull(), _at(path)))


def _list(path: str, fields: str) -> Column:
    kind = f"array<struct<{fields}>>"
    return F.coalesce(_at(path, kind), F.array().cast(kind))


def _urls(items: Column, keep, url=lambda x: x["url"]) -> Column:
    return F.transform(F.filter(items, lambda x: F.coalesce(keep(x), F.lit(False)) & (F.coalesce(url(x), F.lit("")) != "")), url)


def _unique(urls: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(urls, ids.normalize_url)))


def _issns(values: Column) -> Column:
    bare = F.transform(F.filter(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), lambda v: F.upper(F.trim(v)))
    return F.array_distinct(F.transform(bare, lambda v: F.when(v.rlike(r"^(?:\d{8}|\d{7}X)$"), F.concat(F.substring(v, 1, 4), F.lit("-"), F.substring(v, 5, 4))).otherwise(v)))


def _authors(names: Column) -> Column:
    return F.transform(F.filter(names, lambda n: F.coalesce(F.trim(n), F.lit("")) != ""), lambda n: F.struct(F.struct(n.alias("display_name")).alias("author")))


def _venue(name: Column, issns: Column, first: Column) -> Column:
    return F.struct(name.alias("display_name"), issns.alias("issn"), F.coalesce(first, F.get(issns, F.lit(0))).alias("issn_l"))


def _first_of(*lists: Column) -> Column:
    return F.coalesce(*[F.get(x, F.lit(0)) for x in lists])


def _europe_pmc() -> dict[str, Column]:
    links = _list("$.fullTextUrlList.fullTextUrl", "availabilityCode:string,documentStyle:string,url:string")
    open_ = _urls(links, lambda x: x["availabilityCode"] == "OA")
    pdf = _urls(links, lambda x: (x["availabilityCode"] == "OA") & (F.lower(x["documentStyle"]) == "pdf"))
    id_, source = _at("$.id"), _at("$.source")
    numbered = F.when(F.lower(source) == "pmc", F.when(id_.rlike(r"^\d+$"), F.concat(F.lit("PMC"), id_)).when(id_.rlike(r"(?i)^PMC\d+$"), F.upper(id_)))
    pmc = F.coalesce(F.nullif(_at("$.pmcid"), F.lit("")), numbered)
    key = F.concat(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")), F.lit(":"), F.coalesce(id_, pmc, _at("$.doi"), F.lit("")))
    date = F.coalesce(_at("$.firstPublicationDate"), _at("$.electronicPublicationDate"), _at("$.journalInfo.printPublicationDate"), F.concat(_at("$.pubYear"), F.lit("-01-01")))
    names = F.transform(_list("$.authorList.author", "fullName:string"), lambda a: a["fullName"])
    return {
        "id": F.concat(F.lit("europepmc:"), key), "doi": _at("$.doi"), "title": _at("$.title"), "publication_date": date, "publication_year": _at("$.pubYear"), "cited_by_count": _at("$.citedByCount", "int"),
        "source_record_id": key, "abstract": _at("$.abstractText"), "names": names, "pdf_url": _first_of(pdf), "landing_page_url": _first_of(open_), "venue": F.lit(None).cast(VENUE),
        "is_oa": _at("$.isOpenAccess") == "Y", "oa_url": _first_of(pdf, open_),
    }


def _crossref() -> dict[str, Column]:
    date = F.coalesce(*[ids.date_from_parts(F.get(_at(f"$['{k}']['date-parts']", "array<array<int>>"), F.lit(0))) for k in DATES])
    links = _at("$.link", "array<variant>")
    links = F.transform(F.coalesce(links, F.array().cast("array<variant>")), lambda x: F.struct(F.try_variant_get(x, "$.URL", "string").alias("url"), F.try_variant_get(x, "$['content-type']", "string").alias("kind")))
    resource = _at("$.resource.primary.URL")
    pdf = _unique(F.concat(_urls(links, lambda x: F.contains(F.lower(F.coalesce(x["kind"], F.lit(""))), F.lit("pdf")) | F.coalesce(ids.looks_like_pdf(x["url"]), F.lit(False))), F.array(F.when(ids.looks_like_pdf(resource), resource))))
    licences = F.array_distinct(F.transform(_list("$.license", "URL:string"), lambda x: x["URL"]))
    licences = F.filter(licences, lambda u: F.coalesce(F.trim(u), F.lit("")) != "")
    open_ = F.exists(licences, lambda u: F.lower(u).rlike("|".join(x.replace(".", r"\.") for x in OPEN)))
    names = F.transform(_list("$.author", "given:string,family:string,name:string"), lambda a: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))), F.lit("")), a["name"]))
    typed = F.transform(_list("$['issn-type']", "value:string"), lambda x: x["value"])
    issns = _issns(F.coalesce(_at("$.ISSN", "array<string>"), F.when(_at("$.ISSN").isNotNull(), F.array(_at("$.ISSN"))), typed))
    landing = F.coalesce(F.nullif(_at("$.URL"), F.lit("")), resource)
    key = F.coalesce(ids.normalize_doi(_at("$.DOI")), _at("$.URL"), _at("$.member"))
    return {
        "id": F.concat(F.lit("crossref:"), key), "doi": _at("$.DOI"), "title": _first("$.title"), "publication_date": date, "publication_year": F.substring(date, 1, 4), "cited_by_count": _at("$['is-referenced-by-count']", "int"),
        "source_record_id": key, "abstract": _at("$.abstract"), "names": names, "pdf_url": _first_of(pdf), "landing_page_url": landing, "venue": _venue(_first("$['container-title']"), issns, _at("$['ISSN-L']")),
        "is_oa": open_, "oa_url": F.coalesce(_first_of(pdf, licences), landing),
    }


def _doaj() -> dict[str, Column]:
    named = _list("$.bibjson.identifier", "type:string,id:string")
    of = lambda *kinds: F.transform(F.filter(named, lambda x: F.lower(x["type"]).isin(*kinds) & (F.coalesce(x["id"], F.lit("")) != "")), lambda x: x["id"])
    links = _list("$.bibjson.link", "type:string,url:string,content_type:string")
    full = _urls(links, lambda x: F.lower(x["type"]) == "fulltext")
    pdf = _urls(links, lambda x: (F.lower(x["type"]) == "fulltext") & (F.contains(F.lower(F.coalesce(x["content_type"], F.lit(""))), F.lit("pdf")) | F.endswith(F.lower(x["url"]), F.lit(".pdf"))))
    year = _at("$.bibjson.year").try_cast("int")
    month = F.coalesce(_at("$.bibjson.month").try_cast("int"), F.lit(1))
    date = F.when(year.isNotNull(), F.format_string("%04d-%02d-01", year, F.when(month == 0, 1).otherwise(month)))
    doi = F.get(of("doi"), F.lit(0))
    key = F.coalesce(F.nullif(_at("$.id"), F.lit("")), ids.normalize_doi(doi), F.get(full, F.lit(0)))
    issns = _issns(F.concat(of("issn", "pissn", "eissn"), F.array(_at("$.bibjson.journal.issn"), _at("$.bibjson.journal.eissn"))))
    return {
        "id": F.concat(F.lit("doaj:"), key), "doi": doi, "title": _at("$.bibjson.title"), "publication_date": date, "publication_year": year.cast("string"), "cited_by_count": F.lit(None).cast("int"),
        "source_record_id": key, "abstract": _at("$.bibjson.abstract"), "names": F.transform(_list("$.bibjson.author", "name:string"), lambda a: a["name"]), "pdf_url": _first_of(pdf), "landing_page_url": _first_of(pdf, full),
        "venue": _venue(_at("$.bibjson.journal.title"), issns, F.lit(None).cast("string")), "is_oa": F.lit(True), "oa_url": _first_of(pdf, full),
    }


FIELDS = {"europe_pmc": _europe_pmc, "crossref": _crossref, "doaj": _doaj}


def captured_hits(pages: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """Hits of captured pages of all services that have a mapping, in one pass over the pages.

    A page that is no JSON, or has no results, or of another service, has none.
    Fields of another type than expected are null.
    """
    name = F.col(source).alias("literature_source")
    page = pages.filter(F.col(source).isin(*FIELDS)).select(name, F.try_parse_json(body).alias("page"))
    items = F.lit(None).cast("array<variant>")
    for service, path in ITEMS.items():
        items = F.when(F.col("literature_source") == service, F.try_variant_get("page", path, "array<variant>")).otherwise(items)
    listed = page.select("literature_source", F.explode(items).alias("v"))
    services = {service: fields() for service, fields in FIELDS.items()}
    told = {}
    for field in services["doaj"]:
        value = None
        for service, columns in services.items():
            value = F.when(F.col("literature_source") == service, columns[field]) if value is None else value.when(F.col("literature_source") == service, columns[field])
        told[field] = value
    flat = listed.select("literature_source", *[c.alias(k) for k, c in told.items()])
    place = F.struct(F.col("pdf_url"), F.col("landing_page_url"), F.col("venue").alias("source"))
    return flat.select(
        "id", "doi", clean_markup(F.col("title")).alias("title"), "publication_date", "publication_year", "cited_by_count", "literature_source", F.concat_ws(":", "literature_source", "source_record_id").alias("source_record_id"),
        clean_markup(F.col("abstract")).alias("abstract"), F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"), _authors(F.col("names")).alias("authorships"), place.alias("primary_location"),
        F.struct(F.coalesce("is_oa", F.lit(False)).alias("is_oa"), "oa_url").alias("open_access"),
    )


def page_hits(pages: DataFrame, service: str, body: str = "body") -> DataFrame:
    """Hits of captured pages of one service."""
    return captured_hits(pages.select(F.lit(service).alias("_service"), F.col(body).alias("_body")), "_service", "_body")
