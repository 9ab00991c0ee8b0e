"""URL filters by a temporal list join: dated entries become validity intervals, captures meet those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries (kind, key, effective, action, category) to intervals (kind, key, action, category, valid_from, valid_to).

    kind: domain (the name and all below it), host (exactly it) or prefix (host and leading path segments).
    action: block, allow or delist. An entry holds from its date until the next date of its (kind, key);
    of several on one date the last by (action, category) holds. Rows without kind, key or date are ignored."""
    w = Window.partitionBy("kind", "key").orderBy("effective", "action", "category")
    return (
        entries.select("kind", "key", "effective", "action", "category")
        .dropna(subset=["kind", "key", "effective"])
        .withColumn("valid_to", F.lead("effective").over(w))
        .where("action <> 'delist' and (valid_to is null or valid_to > effective)")
        .select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), "action", "category", F.col("effective").alias("valid_from"), "valid_to")
    )


def host_of(url) -> Column:
    """Lower-case host without a leading www., user or port; empty if url has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", "")


def path_of(url) -> Column:
    """The path as written, without query and fragment."""
    return F.regexp_extract(url, PATH, 1)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """captures and, for each: host, blocked, entry, entry_kind, category, listed_from.

    The active entry with the most specific key decides (prefix before host before domain, the longer key first;
    at the same key block before allow). Without one, or without url or date, blocked is false and the rest null.
    Repeated captures each get the verdict. Columns of captures that have these names are replaced.
    The list is broadcast while it is short (counted), else dealt out by key with hot keys split."""
    added = ["host", "blocked", "entry", "entry_kind", "category", "listed_from"]
    captures = captures.drop(*[c for c in captures.columns if c.lower() in added])
    visits = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).dropna().distinct().withColumns({"_host": host_of("_url"), "_path": path_of("_url")}).where("_host <> ''")
    labels, steps = F.split("_host", r"\."), F.filter(F.split("_path", "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("_kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("_key")))
    hosts = F.array(F.struct(F.lit("host").alias("_kind"), F.col("_host").alias("_key")))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("_kind"), F.concat_ws("/", F.col("_host"), F.array_join(F.slice(steps, 1, i), "/")).alias("_key")))).otherwise(F.array().cast("array<struct<_kind:string,_key:string>>"))
    keyed = visits.select("_url", "_at", F.inline(F.concat(domains, hosts, prefixes)))
    met = lookup_join(keyed, validity_intervals(entries), ["_kind", "_key"], "inner", F.col("_url")).where("_at >= valid_from and (valid_to is null or _at < valid_to)")
    rank = F.struct(F.when(F.col("_kind") == "prefix", 2).when(F.col("_kind") == "host", 1).otherwise(0), F.length("_key"), "action")
    verdicts = met.groupBy("_url", "_at").agg(F.max_by(F.struct("action", "_key", "_kind", "category", "valid_from"), rank).alias("_v"))
    return (
        captures.join(verdicts, (captures[url] == verdicts["_url"]) & (captures[fetched] == verdicts["_at"]), "left")
        .select(
            *[captures[c] for c in captures.columns], host_of(captures[url]).alias("host"),
            F.coalesce(F.col("_v.action") == "block", F.lit(False)).alias("blocked"), F.col("_v._key").alias("entry"), F.col("_v._kind").alias("entry_kind"),
            F.col("_v.category").alias("category"), F.col("_v.valid_from").alias("listed_from"),
        )
    )
