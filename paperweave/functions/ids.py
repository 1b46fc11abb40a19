"""Identifiers, URLs, dates and numbers of bibliographic records, as Column functions.

Empty text counts as missing throughout; a value that does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_present(*values: Column) -> Column:
    return F.coalesce(*(present(v) for v in values))


def extract(value: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def normalize_doi(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))), F.lit(""))


def normalize_arxiv_id(value: Column) -> Column:
    """A new-style or else an old-style identifier, without prefix, query and version."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"[?#].*$", "")
    return F.coalesce(extract(bare, r"(\d{4}\.\d{4,5})(?:v\d+)?", 1), extract(bare, r"([a-z][a-z.-]*/\d{7})(?:v\d+)?", 1))


def openalex_work_id(value: Column) -> Column:
    return extract(value, r"W\d+")


def title_year_key(title: Column, year: Column) -> Column:
    """titleyear:{year}:{hash} of a title with four terms and twenty characters at least, else null."""
    clean = F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}]+", " "))
    enough = (F.size(F.split(clean, " ")) >= 4) & (F.length(clean) >= 20)
    return F.when(enough, F.concat(F.lit("titleyear:"), F.coalesce(year.cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha1(clean), 1, 16)))


def record_key(doi: Column, openalex: Column, source: Column, source_id: Column, arxiv: Column) -> Column:
    """The first of: doi, a work id (only where the source is unknown or openalex), the source's own id, arXiv."""
    own = F.when(present(source).isNull() | (F.lower(source) == "openalex"), F.concat(F.lit("openalex:"), openalex_work_id(openalex)))
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        own,
        F.concat(F.lower(present(source)), F.lit(":"), present(source_id)),
        F.concat(F.lit("arxiv:"), normalize_arxiv_id(arxiv)),
    )


def canonical_record_key(doi: Column, arxiv: Column, openalex: Column, title: Column, year: Column) -> Column:
    """A key that does not depend on the source: doi, arXiv, work id, then title and year."""
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("arxiv:"), normalize_arxiv_id(arxiv)),
        F.concat(F.lit("openalex:"), openalex_work_id(openalex)),
        title_year_key(title, year),
    )


def normalize_url(value: Column) -> Column:
    """https, lower-case host, no fragment; null unless it is a web address."""
    text = F.regexp_replace(F.trim(value), "&amp;", "&")
    text = F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).when(text.rlike(r"^[\w.-]+\.[A-Za-z]{2,}(?:/|$)"), F.concat(F.lit("https://"), text)).otherwise(text)
    text = F.regexp_replace(text, r"(?i)^http://", "https://")
    rest = F.regexp_replace(F.regexp_extract(text, r"(?i)^https://[^/?#]+(.*)$", 1), r"#.*$", "")
    return F.when(text.rlike(r"(?i)^https://[^/?#]+"), F.concat(F.lit("https://"), host_of(text), rest))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1))


def host_label(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def looks_like_pdf(url: Column) -> Column:
    low = F.lower(url)
    return strip_query(low).rlike(r"\.pdf$|/pdf(?:/|$)|/pdfft$") | low.rlike(r"[?&](?:format|type)=pdf(?:&|$)")


def normalize_issn(value: Column) -> Column:
    """Digits and X in the form 1234-567X; empty if there are not eight."""
    bare = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^0-9X]", "")
    return F.when(F.length(bare) == 8, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(F.lit(""))


def normalize_journal(value: Column) -> Column:
    named = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "&", " and ")
    return F.trim(F.regexp_replace(named, r"(?U)\W+", " "))


def year_of(value: Column) -> Column:
    """The first year of 1900 to 2099 in a text."""
    return extract(value.cast("string"), r"(?:19|20)\d{2}").try_cast("int")


def facet_year(value: Column) -> Column:
    """The first free-standing year of 1800 to 2199, as text; empty if none."""
    return F.coalesce(extract(value.cast("string"), r"\b(?:18|19|20|21)\d{2}\b"), F.lit(""))


def library_year(*values: Column) -> Column:
    return F.coalesce(*(year_of(v) for v in values), F.lit(0))


def date_from_parts(parts: Column) -> Column:
    """[year, month, day] with month and day 1 if missing, as yyyy-mm-dd; null if it is no date."""
    at = lambda i, other: F.coalesce(F.get(parts, i), F.lit(other))
    text = F.format_string("%04d-%02d-%02d", at(0, None).cast("int"), at(1, 1).cast("int"), at(2, 1).cast("int"))
    return F.when(F.get(parts, 0).isNotNull(), F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def in_date_range(date: Column, year: Column, start: str, end: str) -> Column:
    """By the date, else by the year; unknown dates pass."""
    return F.coalesce(present(date).between(start, end), year.cast("int").between(int(start[:4]), int(end[:4])), F.lit(True))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """The number, or the default where the text is no finite number."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).otherwise(F.lit(default))


def safe_folder_id(value: Column) -> Column:
    clean = F.substring(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), 1, 72)
    return F.concat(clean, F.lit("_"), F.substring(F.sha1(value), 1, 8))


def fingerprint(*columns: Column) -> Column:
    """A digest of the columns' values; equal rows, equal digests."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stable_fraction(value: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the value and salt alone."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt), F.lit(":"), value.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pmc_id(*values: Column) -> Column:
    """The first PMC identifier in the values, in upper case."""
    return F.upper(F.coalesce(*(extract(v, r"(?i)\bPMC\d+\b") for v in values)))


def on_hosts(url: Column, hosts: list[str]) -> Column:
    """Whether the address is on one of the hosts or below it."""
    host = host_of(url)
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith(f".{h}")
    return out


def priority(value: Column, rules: list[tuple[str, int]], otherwise: int = 99) -> Column:
    """The number of the first rule whose pattern the text has."""
    out = F.lit(otherwise)
    for pattern, n in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(n)).otherwise(out)
    return out


#: How the address of a landing page becomes one of a PDF (fixed values, public address forms).
LANDING_RULES = (
    (r"^(https?://arxiv\.org)/abs/(.+)$", "$1/pdf/$2"),
    (r"^(https?://[^/]+/articles/PMC\d+)/?$", "$1/pdf/"),
    (r"^(https?://[^/]+/doi)/(?:abs|full)/(.+)$", "$1/pdf/$2"),
    (r"^(https?://[^?#]+/article/[^?#]+?)/?$", "$1.pdf"),
)


def landing_candidates(url: Column, rules=LANDING_RULES) -> Column:
    """An array of the PDF addresses that the rules give; empty if none fits."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(url.rlike(p), F.regexp_replace(url, p, to)) for p, to in rules])))
