"""Readers of captured records and small tables, with explicit schemas; bad lines end in a column of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..functions.text import clean_markup

#: A search result as the sources deliver it, in the shape that they share.
HIT = """id string, doi string, title string, publication_date string, publication_year string, cited_by_count int,
literature_source string, source_record_id string, abstract string, abstract_inverted_index map<string,array<int>>,
authorships array<struct<author:struct<display_name:string>>>,
primary_location struct<pdf_url:string,landing_page_url:string,source:struct<display_name:string,issn:array<string>,issn_l:string>>,
open_access struct<is_oa:boolean,oa_url:string>"""


def read_json_lines(spark: SparkSession, path: str, schema: str = HIT) -> DataFrame:
    """One record a line; a line that is no record is in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str, max_bytes: int | None = None) -> DataFrame:
    """Documents of one object a file; files over `max_bytes` are left out by their metadata, unread."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.filter(F.col("_metadata.file_size") <= max_bytes) if max_bytes else rows


def read_versioned_cache(spark: SparkSession, path: str, version: int, schema: str = HIT) -> DataFrame:
    """The records of cache documents {version, records}; documents of another version or shape have none."""
    rows = spark.read.schema(f"version int, records array<struct<{_fields(schema)}>>").option("multiLine", True).json(path)
    return rows.filter(F.col("version") == version).select(F.explode("records").alias("_r")).filter("_r IS NOT NULL").select("_r.*")


def _fields(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def read_graphs(spark: SparkSession, path: str, keys: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Graph documents (cacheKey, recordId, nodes, edges), one a file, of the given cache keys or all; larger files are left out unread."""
    rows = read_json_document(spark, path, GRAPH, max_bytes)
    return rows.filter(F.col("cacheKey").isin(keys)) if keys is not None else rows


#: The parts of a stored graph that operators read.
GRAPH = """cacheKey string, recordId string, version int,
nodes array<struct<id:string,type:string,label:string,importance:double,confidence:double>>,
edges array<struct<id:string,source:string,target:string,type:string,confidence:double>>"""


def graph_tables(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents, one row each, with the record that they are of."""
    part = lambda c: graphs.select(F.col("recordId").alias("record"), F.explode(c).alias("_x")).select("record", "_x.*")
    return part("nodes"), part("edges")


def list_files(spark: SparkSession, path: str, limit: int = 10_000) -> DataFrame:
    """(path, modified, bytes), the newest first; contents are not read. `limit` is the length of the report."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.col("modified").desc(), "path").limit(limit)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_dimension(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV table with a header, read by name: a column for each of `columns` (name to type), null where a value is blank or no such thing.

    Quotes and line breaks in them are read, a byte-order mark is no part of the
    first name, columns that the file lacks are null, and rows of blanks are left out.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    plain = {c.removeprefix("\ufeff").strip().lower(): c for c in raw.columns}
    text = {n: F.nullif(F.trim(F.col(f"`{plain[n.lower()]}`")), F.lit("")) if n.lower() in plain else F.lit(None).cast("string") for n in columns}
    number = lambda c, t: F.regexp_replace(c, ",", "").try_cast(t) if t != "string" else c
    some = F.coalesce(*text.values()).isNotNull()
    return raw.filter(some).select(*[number(c, columns[n]).alias(n) for n, c in text.items()])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Journal metrics (journal_title, issn array, issn_l, impact_factor, metric_year, source, quartile, metric_name) from CSV; rows without a title or code are left out."""
    raw = read_dimension(spark, path, {"journal_title": "string", "title": "string", "journal": "string", "issn": "string", "issn_l": "string", "impact_factor": "double", "metric_year": "int", "source": "string", "quartile": "string", "metric_name": "string"})
    codes = F.filter(F.array_distinct(F.transform(F.split(F.coalesce("issn", F.lit("")), r"[;,|\s]+"), ids.normalize_issn)), lambda x: x != "")
    rows = raw.select(
        F.coalesce("journal_title", "title", "journal", F.lit("")).alias("journal_title"),
        codes.alias("issn"),
        ids.normalize_issn(F.col("issn_l")).alias("issn_l"),
        "impact_factor",
        "metric_year",
        F.coalesce("source", F.lit("local_csv")).alias("source"),
        F.coalesce("quartile", F.lit("")).alias("quartile"),
        F.coalesce("metric_name", F.lit("impact_factor")).alias("metric_name"),
    )
    rows = rows.withColumn("issn_l", F.coalesce(F.nullif("issn_l", F.lit("")), F.get("issn", 0), F.lit("")))
    return rows.filter("journal_title != '' OR issn_l != ''")


def read_glossary(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """(source, target) of a glossary; its form is that of the file's name: json, csv, tsv, or lines `a => b`.

    Lines without two parts, comments (# and //), header lines and blank parts
    are left out. CSV fields may be quoted. JSON is an object of terms, or a list
    of objects or lines.
    """
    form = form or path.rsplit(".", 1)[-1].lower()
    arrow = lambda c: (F.trim(F.get(F.split(c, "=>", 2), 0)), F.trim(F.get(F.split(c, "=>", 2), 1)))
    spoken = lambda c: ~F.trim(c).rlike("^(?:#|//)")
    if form == "json":
        text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
        table = F.from_json("v", "map<string,string>")
        listed = F.from_json("v", "array<string>")
        pairs = text.filter(F.col("v").startswith("{")).select(F.explode(F.map_entries(table)).alias("e")).select(F.trim("e.key").alias("source"), F.trim("e.value").alias("target"))
        items = text.filter(F.col("v").startswith("[")).select(F.explode(listed).alias("i"))
        first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object("i", f"$.{n}")), F.lit("")) for n in names])
        object_ = F.trim("i").startswith("{")
        left, right = arrow(F.col("i"))
        rows = items.filter(object_ | spoken(F.col("i"))).select(
            F.when(object_, first("source", "src", "en", "term")).otherwise(left).alias("source"),
            F.when(object_, first("target", "dst", "zh", "translation")).otherwise(right).alias("target"),
        )
        rows = pairs.unionByName(rows)
    elif form in ("csv", "tsv"):
        raw = spark.read.schema("a string, b string").option("sep", "\t" if form == "tsv" else ",").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        a, b = F.regexp_replace("a", "^\ufeff", ""), F.trim("b")
        left, right = arrow(a)
        alone = F.coalesce(b, F.lit("")) == ""
        rows = raw.filter(~alone | spoken(a)).select(F.when(alone, left).otherwise(F.trim(a)).alias("source"), F.when(alone, right).otherwise(b).alias("target"))
        rows = rows.filter(~F.lower("source").isin("source", "english", "en", "term"))
    else:
        lines = spark.read.text(path).filter(spoken(F.col("value")))
        left, right = arrow(F.col("value"))
        rows = lines.select(left.alias("source"), right.alias("target"))
    return rows.filter("source != '' AND target != ''")


#: What is read of an Atom feed of search results.
ATOM = """entry array<struct<id:string,published:string,title:string,summary:string,doi:string,
author:array<struct<name:string>>,link:array<struct<_href:string,_rel:string,_title:string>>>>"""


def atom_hits(pages: DataFrame, page: str, source: str = "arxiv", first: str | None = None, last: str | None = None) -> DataFrame:
    """Captured Atom pages as hits (see HIT), one row an entry published from `first` to `last`; entries without a date pass. A page that is no feed has none."""
    feed = F.from_xml(F.col(page), ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    e = pages.filter(F.col(page).isNotNull()).select(feed.alias("_f")).select(F.explode("_f.entry").alias("e")).select("e.*")
    day = F.substring("published", 1, 10)
    if first and last:
        e = e.filter(F.coalesce("published", F.lit("")).isin("") | day.between(first, last))
    link = lambda name: F.get(F.filter("link", lambda x: F.coalesce(x["_title"], x["_rel"]) == name), 0)["_href"]
    names = F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: F.struct(F.struct(a["name"].alias("display_name")).alias("author")))
    landing = F.struct(link("pdf").alias("pdf_url"), link("alternate").alias("landing_page_url"), F.lit(None).cast("struct<display_name:string,issn:array<string>,issn_l:string>").alias("source"))
    return e.select(
        "id",
        "doi",
        clean_markup(F.col("title")).alias("title"),
        F.nullif(day, F.lit("")).alias("publication_date"),
        F.nullif(F.substring("published", 1, 4), F.lit("")).alias("publication_year"),
        F.lit(None).cast("int").alias("cited_by_count"),
        F.lit(source).alias("literature_source"),
        F.concat(F.lit(f"{source}:"), F.col("id")).alias("source_record_id"),
        clean_markup(F.col("summary")).alias("abstract"),
        F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"),
        names.alias("authorships"),
        landing.alias("primary_location"),
        F.struct(F.lit(True).alias("is_oa"), F.coalesce(link("pdf"), link("alternate")).alias("oa_url")).alias("open_access"),
    )


def read_sql_table(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A query over JDBC, in ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def abstract_from_index(index: Column) -> Column:
    """The words of an inverted index in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


def to_records(hits: DataFrame) -> DataFrame:
    """Records of one shape from search results: keys, cleaned text, names, journal, year, access."""
    venue = F.col("primary_location.source")
    issns = F.filter(F.array_distinct(F.transform(F.concat(F.coalesce(venue["issn"], F.array().cast("array<string>")), F.array(venue["issn_l"])), ids.normalize_issn)), lambda x: x != "")
    names = F.slice(F.filter(F.transform(F.coalesce("authorships", F.array().cast(hits.schema["authorships"].dataType)), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()), 1, 12)
    arxiv = F.when(F.lower("literature_source") == "arxiv", F.col("source_record_id"))
    year = F.coalesce(ids.year_of(F.col("publication_year")), ids.year_of(F.col("publication_date")))
    # a column of its own: Spark cannot take the index's lambdas into the arguments of a Python function
    said = F.coalesce(ids.present(F.col("abstract")), abstract_from_index(F.col("abstract_inverted_index")))
    hits = hits.withColumn("_abstract", F.explode(F.array(said)))
    return hits.select(
        ids.record_key(F.col("doi"), F.col("id"), F.col("literature_source"), F.col("source_record_id"), arxiv).alias("record_key"),
        ids.canonical_record_key(F.col("doi"), arxiv, F.col("id"), F.col("title"), year).alias("canonical_key"),
        clean_markup(F.col("title")).alias("title"),
        clean_markup(F.col("_abstract")).alias("abstract"),
        year.alias("year"),
        names.alias("authors"),
        venue["display_name"].alias("journal"),
        issns.alias("issns"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
    )


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Several sources as one, columns matched by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def change_stream(spark: SparkSession, path: str, schema: str | T.StructType, per_trigger: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream; the checkpoint of the query holds the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def page_links(pages: DataFrame, id_: str, url: str, html: str) -> DataFrame:
    """(id, place, kind, link): addresses in the meta, link, iframe and anchor tags of a page, as absolute normalized addresses."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<((?:a|link|iframe|meta)\b[^>]*)>"), F.lit(1))
    found = pages.select(F.col(id_).alias("id"), F.col(url).alias("base"), F.posexplode(tags).alias("place", "tag"))
    raw = F.regexp_extract("tag", r"(?is)\b(?:href|src|content)\s*=\s*[\"']?([^\"'\s>]+)", 1)
    host = F.regexp_extract("base", r"(?i)^(https?://[^/?#]+)", 1)
    absolute = F.when(raw.startswith("/") & ~raw.startswith("//"), F.concat(host, raw)).otherwise(raw)
    return found.select("id", "place", F.lower(F.regexp_extract("tag", r"^(\w+)", 1)).alias("kind"), ids.normalize_url(absolute).alias("link")).filter("link IS NOT NULL")
