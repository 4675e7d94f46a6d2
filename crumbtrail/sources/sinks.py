"""Writers. Parquet is the format in between; JSON and CSV are for the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of published tables, in their order.
PET_FIELDS = [
    "domain", "source_mode", "run_id", "category", "pet_name", "measurement_mode", "browser_name", "browser_version", "extension_name", "extension_version",
    "extension_path", "extension_enabled", "consent_banner_detected", "page_load_time_ms", "total_cookies", "tracker_cookies", "tracker_domains",
    "total_third_party_domains", "total_requests", "blocked_requests", "blocked_tracker_requests", "success", "error",
]
SCORE_FIELDS = [
    "domain", "source_mode", "run_id", "category", "region", "rank", "overall_score", "grade", "no_pre_consent_trackers", "reject_option_available",
    "equal_accept_reject_effort", "no_dark_patterns", "post_reject_compliance", "transparent_information", "cmp_detected", "dark_pattern_count",
    "pre_consent_tracker_count", "total_pre_consent_cookies",
]
CMP_FIELDS = [
    "source_mode", "run_id", "cmp_name", "site_count", "avg_compliance_score", "median_compliance_score", "pct_with_reject_button", "pct_reject_works",
    "avg_tracker_reduction", "pct_with_dark_patterns", "pet_score", "rank",
]
ENVELOPE = ["source_mode", "run_id", "generated_at", "proxy_used", "browser_name", "browser_version", "site_list_source"]
HEAVY = ["cookies", "http_requests"]


def stamp(df: DataFrame, **run: str) -> DataFrame:
    """Provenance columns; a row's own value goes before the run's."""
    own: dict[str, Column] = {k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in run.items()}
    return df.withColumns(own)


def per_site(rows: DataFrame, site: str, name: str) -> DataFrame:
    """One document per site with its rows as an array."""
    rest = [c for c in rows.columns if c != site]
    return rows.groupBy(site).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def in_order(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of a published table; what df lacks is null, what it has beyond is left out."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def envelope(rows: DataFrame, site: str, name: str, run: dict[str, str]) -> DataFrame:
    """One document per site: the run's provenance, then its rows under a name. run: values of ENVELOPE; others are null."""
    if not set(run) <= set(ENVELOPE):
        raise ValueError(f"no fields of the envelope: {sorted(set(run) - set(ENVELOPE))}")
    docs = per_site(rows, site, name)
    return docs.select(site, *[F.lit(run.get(c)).cast("string").alias(c) for c in ENVELOPE], name)


def slim(docs: DataFrame) -> DataFrame:
    """Documents without their heavy columns."""
    return docs.drop(*HEAVY)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "parquet", by: str | None = None) -> None:
    """Replaces a table, or with ``by`` only the partitions that df holds."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite")
    if by:
        out = out.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    out.format(fmt).option("header", True).save(path)


def append_missing(df: DataFrame, existing: DataFrame, path: str, key: str, force: bool = False) -> None:
    """Writes the rows whose key is not there yet; all of them, in place of what is there, with force."""
    if force:
        df.write.mode("overwrite").parquet(path)
    else:
        df.join(existing.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def report_row(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of JSON from small aggregate tables, each as an array of its rows."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
