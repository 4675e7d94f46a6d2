"""Readers with explicit schemas. A missing path gives an empty table of the schema where that is said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from crumbtrail.functions.text import null_like

_COOKIE = "struct<name: string, value: string, domain: string, path: string, expires: double, httpOnly: boolean, secure: boolean, sameSite: string>"
_REQUEST = "struct<url: string, method: string, resource_type: string, domain: string, cookie_header: string, referer: string>"
_STATE = (
    f"struct<cookies: array<{_COOKIE}>, http_requests: array<{_REQUEST}>, third_party_domains: array<string>, local_storage: map<string, string>, "
    "session_storage: map<string, string>, total_cookies: int, total_third_party_domains: int, total_requests: int, reject_button_found: boolean, reject_successful: boolean>"
)
_STYLES = "struct<width: string, height: string, background_color: string, color: string, font_size: string, font_weight: string, display: string, visibility: string>"
_BUTTON = f"struct<text: string, tag: string, type: string, selector: string, computed_styles: {_STYLES}>"
_BANNER = (
    f"struct<found: boolean, selector: string, html: string, text_content: string, buttons: array<{_BUTTON}>, has_accept_button: boolean, "
    "has_reject_button: boolean, accept_clicks_required: int, reject_clicks_required: int>"
)
CRAWL = (
    "domain string, category string, region string, rank int, crawl_timestamp string, success boolean, error string, cmp_detected string, "
    f"consent_banner {_BANNER}, pre_consent {_STATE}, post_consent_accept {_STATE}, post_consent_reject {_STATE}, source_mode string, run_id string, _corrupt_record string"
)


def read_sites(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Site list with a header; rows without domain are dropped. Without a column of that name the first one holds the
    domains. first: the n best-ranked sites."""
    df = spark.read.csv(path, header=True)
    name = "domain" if "domain" in df.columns else df.columns[0]
    kinds = {"category": "string", "region": "string", "rank": "int"}
    rest = [F.col(c).try_cast(t).alias(c) if c in df.columns and c != name else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    df = df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("domain"), *rest)
    return df.orderBy("rank", "domain").limit(first) if first else df


def read_crawl(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per crawl document below path; unreadable files are left out, a missing domain is the file's name. With ``lines`` each
    line is a document, and unreadable lines are left out: many sites need no more files than their size asks for."""
    raw = spark.read.schema(CRAWL).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    named = raw if lines else raw.withColumn("domain", F.coalesce("domain", stem))
    return named.where("_corrupt_record IS NULL").drop("_corrupt_record")


def states_long(crawl: DataFrame) -> DataFrame:
    """The three states of each document as rows; a state without any content counts as absent."""
    names = {"pre": "pre_consent", "accept": "post_consent_accept", "reject": "post_consent_reject"}
    rows = F.array(*[F.struct(F.lit(k).alias("state"), F.col(c).alias("content")) for k, c in names.items()])
    df = crawl.select("domain", F.explode(rows).alias("s")).select("domain", "s.state", "s.content.*")
    return df.where("cookies IS NOT NULL OR http_requests IS NOT NULL OR third_party_domains IS NOT NULL")


def cookies_long(states: DataFrame) -> DataFrame:
    return states.select("domain", "state", F.posexplode("cookies").alias("seq", "c")).select(F.col("domain").alias("site"), "state", "seq", F.col("c.domain").alias("cookie_domain"), "c.name", "c.path", "c.expires")


def read_banner_html(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html?$", "").alias("domain"), F.col("value").alias("html"))


def read_filter_list(spark: SparkSession, path: str) -> DataFrame:
    from crumbtrail.operators.classify import adblock_domains

    return adblock_domains(spark.read.text(path), "value")


def hosts_domains(lines: DataFrame, col: str = "line") -> DataFrame:
    """Distinct domains of a hosts file (address, blank, domain); comments do not count."""
    found = F.lower(F.regexp_extract(F.trim(F.col(col)), r"^(?:127\.0\.0\.1|0\.0\.0\.0)\s+([A-Za-z0-9._-]+)", 1))
    return lines.select(found.alias("domain")).where("domain <> ''").distinct()


def tracker_services(docs: DataFrame, col: str = "json", order: str | None = None) -> DataFrame:
    """domain, vendor, category of a services document {categories: {category: [{company: {url: [domains]}}]}};
    flags named dnt and performance are not lists of domains; the last entry of a domain counts. order: the column by which
    several documents follow each other."""
    kinds = "map<string, array<map<string, map<string, string>>>>"
    top = docs.select((F.col(order) if order else F.lit(0)).alias("o"), F.from_json(F.get_json_object(col, "$.categories"), kinds).alias("m"))
    cats = top.select("o", F.posexplode(F.map_entries("m")).alias("i", "e")).select("o", "i", F.col("e.key").alias("category"), F.col("e.value").alias("list"))
    entries = cats.select("o", "i", "category", F.posexplode("list").alias("j", "entry")).select("o", "i", "j", "category", F.posexplode(F.map_entries("entry")).alias("k", "c"))
    pairs = entries.select("o", "i", "j", "k", "category", F.col("c.key").alias("vendor"), F.posexplode(F.map_entries("c.value")).alias("l", "p"))
    pairs = pairs.where(~F.col("p.key").isin("dnt", "performance"))
    listed = F.from_json(F.col("p.value"), "array<string>")
    own = F.when(F.contains(F.col("p.key"), F.lit(".")) & ~F.col("p.value").startswith("["), F.array(F.col("p.key")))
    rows = pairs.select("o", "i", "j", "k", "l", "category", "vendor", F.posexplode(F.coalesce(own, listed)).alias("m", "d"))
    last = F.max_by(F.struct("vendor", "category"), F.struct("o", "i", "j", "k", "l", "m"))
    return rows.groupBy(F.lower("d").alias("domain")).agg(last.alias("x")).select("domain", "x.vendor", "x.category")


def merge_tracker_lists(lists: list[DataFrame]) -> DataFrame:
    """One row per domain: of several lists the earlier one counts."""
    out = None
    for priority, df in enumerate(lists):
        part = df.select("domain", "vendor", "category").withColumn("priority", F.lit(priority))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("domain").orderBy("priority", "vendor", "category")
    return out.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def stale_files(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """Files below path that were last changed more than so many days before a time."""
    df = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return df.where(F.col("modificationTime") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table in CSV; empty if there is none."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def unwrap(docs: DataFrame, json_col: str, key: str, element: str) -> DataFrame:
    """Items of a payload that is a bare list or an envelope with the list under a key."""
    bare = F.from_json(F.col(json_col), f"array<{element}>")
    inside = F.from_json(F.get_json_object(json_col, f"$.{key}"), f"array<{element}>")
    rest = [c for c in docs.columns if c != json_col]
    return docs.select(*rest, F.explode(F.when(F.ltrim(json_col).startswith("["), bare).otherwise(inside)).alias("item"))


def result_items(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """The entries of result documents of any shape and depth, as variants: a bare list, or an envelope with the list under
    ``results``. One row (other columns, run_id, site_list_source, item) for each entry that is an object; the two names are those
    of the envelope. Documents that are neither, or no JSON, give no rows."""
    rest = [c for c in docs.columns if c != json_col]
    doc = docs.select(*rest, F.try_parse_json(json_col).alias("v_"))
    text = lambda path: F.try_variant_get("v_", f"$.{path}", "string").alias(path)
    doc = doc.select(*rest, text("run_id"), text("site_list_source"), F.coalesce(F.try_variant_get("v_", "$.results", "variant"), "v_").alias("list_"))
    doc = doc.where(F.schema_of_variant("list_").startswith("ARRAY"))
    each = doc.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("list_").outer()))
    return each.where(F.schema_of_variant("value").startswith("OBJECT")).select(*rest, "run_id", "site_list_source", F.col("value").alias("item"))


def merged_results(docs: DataFrame, fields: dict[str, str], source_mode: str, json_col: str = "json") -> DataFrame:
    """The entries of all documents with the fields asked for (name: type, null where an entry lacks it), the mode of the output, and
    the run id and site list that all envelopes which name one have in common, or null."""
    items = result_items(docs, json_col)
    named = docs.select(F.try_parse_json(json_col).alias("v"))
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(f"common_{c}")
    names = named.select(*[F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("run_id", "site_list_source")])
    common = names.select(*[null_like(F.col(c)).alias(c) for c in names.columns]).agg(one("run_id"), one("site_list_source"))
    got = [F.try_variant_get("item", f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    rows = items.select(*got).crossJoin(F.broadcast(common))  # one row on one side
    return rows.select(*fields, F.lit(source_mode).alias("source_mode"), F.col("common_run_id").alias("run_id"), F.col("common_site_list_source").alias("site_list_source"))


def services_by_variant(docs: DataFrame, col: str = "json") -> DataFrame:
    """domain, vendor, category, place of a services document, level by level without a schema: tracker_services() for documents whose
    entries vary. place orders the entries; a company's own domain counts where its entry is no list."""
    tvf = docs.sparkSession.tvf
    level = lambda df, v, *names: df.lateralJoin(tvf.variant_explode(F.col(v).outer()).toDF(*names))
    top = docs.select(F.try_variant_get(F.try_parse_json(col), "$.categories", "variant").alias("v0"))
    df = level(top, "v0", "i", "category", "v1")
    df = level(df, "v1", "j", "k1", "v2")
    df = level(df, "v2", "k", "vendor", "v3")
    df = level(df, "v3", "l", "url", "v4").where(~F.col("url").isin("dnt", "performance"))
    df = level(df.where(F.schema_of_variant("v4").startswith("ARRAY")), "v4", "m", "k5", "v5")
    domain = F.lower(F.try_variant_get("v5", "$", "string"))
    return df.where(domain.isNotNull()).select(domain.alias("domain"), "vendor", "category", F.struct("i", "j", "k", "l", "m").alias("place"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Labels of consent buttons from JSON lines or documents {action: {exact: [..], contains: [..]}}: action, kind, ord, term,
    of any number. ord follows reject, accept, settings, dismiss, others."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<exact: array<string>, contains: array<string>>>").alias("m"))
    each = raw.select(F.explode("m").alias("action", "t"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"t.{k}").alias("terms")) for k in ("exact", "contains")])
    rows = each.select("action", F.explode(kinds).alias("k")).select("action", "k.kind", F.explode("k.terms").alias("term"))
    place = F.array_position(F.array(*[F.lit(a) for a in ("reject", "accept", "settings", "dismiss")]), F.col("action"))
    return rows.select("action", "kind", F.when(place > 0, place - 1).otherwise(4).cast("int").alias("ord"), "term").where("term IS NOT NULL")
