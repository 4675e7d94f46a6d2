"""Column functions over hosts, URLs and cookie keys. All stay in the JVM and are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crumbtrail.plans.params import GOV_SUFFIXES, TWO_LABEL_SUFFIXES


def registered_domain(host: Column) -> Column:
    """The last two labels, three if the last two are a two-label suffix; leading dots and case do not count."""
    clean = F.lower(F.ltrim(host, F.lit(".")))
    last = lambda n: F.substring_index(clean, ".", -n)
    return F.when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def registered_by_list(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host", unknown: int = 0) -> DataFrame:
    """hosts with ``registered``: the public suffix and one label more. suffixes: suffix, of any number of labels, with
    rules such as ``*.ck`` and exceptions such as ``!www.ck``; of several that fit the longest counts, an exception before all.
    A host none of whose endings is listed has a suffix of ``unknown`` labels. Both sides meet by key, so the list may be of any size."""
    own = hosts.select(host_col).distinct().withColumn("clean_", F.lower(F.ltrim(F.regexp_replace(F.regexp_replace(host_col, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/:?#].*$", ""), F.lit("."))))
    parts = F.split("clean_", r"\.")
    n = F.size(parts)
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    # Each host by all its endings, exact ones and with a star for the first label.
    forms = lambda k: F.array(
        F.struct(tail(k).alias("suffix"), k.alias("labels"), F.lit(0).alias("exact")),
        F.struct(F.concat(F.lit("*."), tail(k - 1)).alias("suffix"), k.alias("labels"), F.lit(1).alias("exact")),
        F.struct(F.concat(F.lit("!"), tail(k)).alias("suffix"), (k - 1).alias("labels"), F.lit(-1).alias("exact")),
    )
    each = own.select(host_col, "clean_", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), forms))).alias("f")).select(host_col, "clean_", "f.*")
    fits = each.join(suffixes.select("suffix").distinct(), "suffix", "left_semi")
    best = fits.groupBy(host_col).agg(F.max_by("labels", F.struct(F.col("exact") == -1, "labels")).alias("labels_"))
    found = own.join(best, host_col, "left").withColumn("labels_", F.coalesce("labels_", F.lit(unknown)))
    registered = F.when(F.col("labels_") >= n, F.col("clean_")).otherwise(tail(F.col("labels_") + 1))
    return hosts.join(found.select(host_col, registered.alias("registered")), host_col, "left")


def is_third_party(host: Column, site: Column) -> Column:
    return registered_domain(host) != registered_domain(site)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def page_key(url: Column) -> Column:
    """Origin and path, without query and fragment."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)", 1)


def cookie_key(name: Column, domain: Column, path: Column) -> Column:
    return F.concat_ws("|", name, domain, path)


def is_public_sector(host: Column) -> Column:
    return F.lower(host).rlike("(" + "|".join(s.replace(".", r"\.") for s in GOV_SUFFIXES) + ")$")


_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[?[0-9a-f:]*:[0-9a-f:.]*\]?)$"


def base_domains(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts with ``base``: the public suffix and one label, the last two labels if no suffix is listed, and an
    address as it is."""
    own = hosts.select(F.rtrim(F.lower(host_col), F.lit(".")).alias(host_col)).where(F.col(host_col) != "").distinct()
    address = F.col(host_col).rlike(_ADDRESS)
    found = registered_by_list(own.where(~address), suffixes, host_col, unknown=1).withColumnRenamed("registered", "base")
    return found.select(host_col, "base").unionByName(own.where(address).select(host_col, F.col(host_col).alias("base")))


def parent_chain(host: Column, base: Column) -> Column:
    """The host, its parent and so on, down to base, which is its own ending or, to go to the very end, its last label."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    steps = n - F.size(F.split(base, r"\."))
    return F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(0)) + 1), lambda i: F.array_join(F.slice(parts, i, n), "."))


def explode_subdomains(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host", *, whole: bool = False) -> DataFrame:
    """(host, pos, parent): each distinct host and its parents, down to its base domain; whole: down to the last label."""
    base = base_domains(hosts, suffixes, host_col)
    end = F.substring_index(host_col, ".", -1) if whole else F.col("base")
    return base.select(host_col, F.posexplode(parent_chain(F.col(host_col), end)).alias("pos", "parent"))


def expiration_days(expires: Column, as_of: Column) -> Column:
    """Whole days that a cookie lives; 0 for session cookies and those that are past."""
    days = F.round((expires - as_of) / 86400).cast("long")
    return F.when(expires.isNull() | (expires <= 0), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), days))
