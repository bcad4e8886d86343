"""Classification of captures and the temporal URL index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import NON_NATIVE_EXTENSIONS, content_is_html, ext_of, ts_number
from ..functions.urls import key, www_toggled
from ..sources.captures import visible
from .ranking import ranked

#: Captures in one list of the grouped index.
LISTED = 10_000


def classify(captures: DataFrame) -> DataFrame:
    """``captures`` with is_wayback, ts, ts_dir, host, port and url_path; is_wayback is null for files of neither layout.

    Wayback: https/web.archive.org/web/<ts>[flags]/<host>[/<port>]/<path>, whose host keeps its case.
    Direct: <http|https|ftp>/<host>[/<port>]/<path>, whose host is lower-cased.
    """
    parts = F.split("archive_path", "/")
    at = lambda i: F.get(parts, F.lit(i))
    low = lambda i: F.lower(at(i))
    archived = low(0).isin("http", "https") & (low(1) == "web.archive.org") & (F.size(parts) >= 4) & (low(2) == "web")
    ts = F.regexp_extract(at(3), r"^(\d{4,14})", 1)
    kind = F.when(F.coalesce(archived, F.lit(False)), F.when((ts != "") & (F.size(parts) > 4), F.lit(True))).when((F.size(parts) >= 2) & low(0).isin("http", "https", "ftp"), F.lit(False))
    first = F.when(F.col("is_wayback"), 4).otherwise(1)
    has_port = F.coalesce(F.get(parts, first + 1).rlike(r"^\d+$"), F.lit(False))
    start = first + F.when(has_port, 3).otherwise(2)
    out = captures.withColumn("is_wayback", kind)
    host = F.when(F.col("is_wayback"), F.get(parts, first)).when(F.col("is_wayback").isNotNull(), F.lower(F.get(parts, first)))
    return (
        out.withColumn("ts", F.when(F.col("is_wayback"), ts))
        .withColumn("ts_dir", F.when(F.col("is_wayback"), at(3)))
        .withColumn("host", host)
        .withColumn("port", F.when(F.col("is_wayback").isNotNull(), F.when(has_port, F.get(parts, first + 1)).otherwise("")))
        .withColumn("url_path", F.when(F.col("is_wayback").isNotNull(), F.array_join(F.slice(parts, start, F.greatest(F.size(parts) - start + 1, F.lit(0))), "/")))
        .withColumn("protocol", F.when(F.col("is_wayback") == False, low(0)))  # noqa: E712
    )


def url_keys():
    """All URL keys of a classified capture: protocols by www; a Wayback capture has lost its protocol."""
    hosts = F.array("host", www_toggled(F.col("host")))
    protocols = F.when(F.col("is_wayback"), F.array(F.lit("http"), F.lit("https"))).otherwise(F.array("protocol"))
    return F.flatten(F.transform(protocols, lambda p: F.transform(hosts, lambda h: key(p, h, F.col("port"), F.col("url_path")))))


def scan(captures: DataFrame) -> DataFrame:
    """Classified captures of one of the two layouts, without hidden files."""
    return classify(visible(captures)).filter("is_wayback IS NOT NULL")


def url_entries(captures: DataFrame) -> DataFrame:
    """(url_key, archive_path, ts, ts_num, ts_dir) of every capture under each of its keys."""
    return scan(captures).select(F.explode(url_keys()).alias("url_key"), "archive_path", "ts", ts_number(F.col("ts")).alias("ts_num"), "ts_dir")


def url_index(captures: DataFrame) -> DataFrame:
    """``url_entries``, each path once for a key."""
    return url_entries(captures).dropDuplicates(["url_key", "archive_path"])


def index_pages(index: DataFrame) -> DataFrame:
    """(url_key, page, n_entries, paths): each key's captures in order of path, in lists of at most LISTED."""
    placed = ranked(index.select("url_key", "archive_path"), ["url_key"], [F.col("archive_path")])
    paged = placed.withColumn("page", F.expr(f"(pos - 1) div {LISTED}"))
    return paged.groupBy("url_key", "page").agg(F.count("*").alias("n_entries"), F.sort_array(F.collect_list("archive_path")).alias("paths"))


def sniffed(captures: DataFrame) -> DataFrame:
    """The files of server-side types, and whether their content is HTML. Only their contents are read."""
    return captures.filter(ext_of(F.col("archive_path")).isin(*NON_NATIVE_EXTENSIONS)).select("archive_path", content_is_html(F.col("content")).alias("is_html"))


def archive_stats(captures: DataFrame) -> DataFrame:
    """One row of counts: files, wayback, direct, url keys, pages' types sniffed as HTML and as other."""
    files = scan(captures)
    counts = files.agg(F.count("*").alias("files"), F.count_if("is_wayback").alias("wayback_files"), F.count_if(~F.col("is_wayback")).alias("direct_files"))
    keys = url_index(captures).agg(F.count_distinct("url_key").alias("unique_keys"), F.count("*").alias("index_entries"))
    types = sniffed(files).agg(F.count_if("is_html").alias("sniffed_html"), F.count_if(~F.col("is_html")).alias("sniffed_other"))
    # Three tables of one row each.
    return counts.join(F.broadcast(keys), F.lit(True)).join(F.broadcast(types), F.lit(True))
