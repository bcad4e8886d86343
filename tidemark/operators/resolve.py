"""Resolution of links and requests to the best capture: ranked equi-joins on URL keys.

A link is tried under several keys. Where the wanted time is one and the same for all links, each
key of the index is reduced to its best capture before the join, so that a page with very many
captures, or with very many links to it, gives one row for each link and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import sanitize, strip_query, ts_number, ts_seconds
from ..functions.urls import DEFAULT_DOCS, fallback_path, key, page_context, parse_link, wayback_lookup, www_toggled
from ..sources.staging import merged, staged
from .lookup import Lookup, chunked, files, snapshots


def probe_keys(u: Column, with_extensions: bool) -> Column:
    """The keys to try for a parsed URL, best first, each once."""
    path = u["pathname"]
    clean = F.regexp_replace(path, "/$", "")
    folder = F.when(path.endswith("/"), F.transform(F.array(*map(F.lit, DEFAULT_DOCS)), lambda d: F.concat(clean, F.lit("/"), d))).otherwise(F.array().cast("array<string>"))
    paths = F.concat(F.array(path, F.concat(clean, F.lit("/index.html"))), folder)
    if with_extensions:
        bare = ~path.rlike(r"\.[a-zA-Z0-9]{1,10}$") & (path != "/")
        paths = F.concat(paths, F.when(bare, F.array(F.concat(path, F.lit(".html")), F.concat(path, F.lit(".htm")))).otherwise(F.array().cast("array<string>")))
    other = F.when(u["protocol"] == "http", "https").otherwise("http")
    pairs = F.array(*[F.struct(p.alias("p"), h.alias("h")) for p in (u["protocol"], other) for h in (u["hostname"], www_toggled(u["hostname"]))])
    return F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.transform(paths, lambda q: key(x["p"], x["h"], u["port"], q)))))


def best_captures(index: DataFrame, target: int) -> DataFrame:
    """(url_key, ts_dir, distance, archive_path): of each key and folder the capture nearest to ``target``.

    Written once: what resolves links of several kinds reads the same table.
    """
    distance = F.abs(F.col("ts_num") - F.lit(target))
    best = index.groupBy("url_key", "ts_dir").agg(F.min(F.struct(distance.alias("distance"), "archive_path")).alias("best"))
    return staged(best.select("url_key", "ts_dir", "best.distance", "best.archive_path"), "best", freed=True)


#: What names a link's resolution: its kind, the URL that is looked up, and of a Wayback link or page the folder and host.
ASKED = ["kind", "lookup", "ts_dir", "host"]


def resolve(asked: DataFrame, best: DataFrame) -> DataFrame:
    """``asked`` (kind, lookup, ts_dir, host; no nulls) with target_path, for those that have a capture; each once.

    ``best`` is of ``best_captures``. Of all captures under the tried keys the best has the URL's own protocol, then the
    smallest distance of its timestamp as a number, then the earlier key, then the first path. An ``absolute`` link is
    tried with extensions added. For a ``wayback`` link a capture in its own folder comes before all else, and no
    extensions are added. A ``root`` link has four attempts: as a Wayback link of its page's folder and host under http and
    https, and with extensions added under http and https. All kinds and attempts meet the index in one go, ranked. The
    keys under http and https are the same but for their order, so that https is tried only where a host has a port,
    which one of them may imply.
    """
    root = F.col("kind") == "root"
    schemes = F.when(root & F.col("host").contains(":"), F.array(F.lit("http://"), F.lit("https://"))).when(root, F.array(F.lit("http://"))).otherwise(F.array(F.lit("")))
    asked = asked.select(*ASKED).distinct().select(*ASKED, F.posexplode(schemes).alias("attempt", "scheme"))
    asked = asked.withColumn("address", F.when(root, F.concat("scheme", "host", "lookup")).otherwise(F.col("lookup"))).drop("scheme")
    # Pages in very many folders ask for the same addresses: each is parsed, and its keys are tried, once.
    # An address without a parse has null keys, which meet nothing.
    urls = asked.select("kind", "address").distinct().withColumn("u", parse_link(F.col("address")))
    urls = urls.withColumn("plain", probe_keys(F.col("u"), False)).withColumn("wide", probe_keys(F.col("u"), True))
    flagged = lambda keys, added: F.transform(keys, lambda k: F.struct(F.lit(added).alias("added"), k.alias("url_key")))
    keys = F.when(F.col("kind") == "absolute", flagged(F.col("wide"), False)).when(root, F.concat(flagged(F.col("plain"), False), flagged(F.array_except("wide", "plain"), True))).otherwise(flagged(F.col("plain"), False))
    probes = urls.select("kind", "address", F.col("u.protocol").alias("protocol"), F.posexplode(keys).alias("key_rank", "k"))
    probes = probes.select("kind", "address", "key_rank", "k.url_key", "k.added", (F.substring_index("k.url_key", "://", 1) != F.col("protocol")).alias("other_protocol"))
    of_key = best.groupBy("url_key").agg(F.min(F.struct("distance", "archive_path")).alias("b")).select("url_key", "b.distance", "b.archive_path")
    # One hit for each of an address's keys at most, some sixty.
    hits = probes.join(merged(of_key), "url_key").groupBy("kind", "address").agg(F.collect_list(F.struct("key_rank", "url_key", "added", "other_protocol", "distance", "archive_path")).alias("hits"))
    met = asked.join(merged(hits), ["kind", "address"])
    order = lambda h, elsewhere, found: F.struct((F.col("attempt") + F.when(h["added"], 2).otherwise(0)).alias("attempt"), elsewhere.alias("elsewhere"), h["other_protocol"].alias("other_protocol"), found["distance"].alias("distance"), h["key_rank"].alias("key_rank"), found["archive_path"].alias("archive_path"))
    apart = lambda h: (F.col("kind") != "absolute") & ~h["added"] & ~h["archive_path"].contains(F.concat(F.lit("/"), F.col("ts_dir"), F.lit("/")))
    nearest = met.select(*ASKED, F.array_min(F.transform("hits", lambda h: order(h, apart(h), h))).alias("b"))
    own = met.filter("kind <> 'absolute'").select(*ASKED, "attempt", F.explode("hits").alias("h")).withColumn("url_key", F.col("h.url_key"))
    exact = own.join(merged(best), ["url_key", "ts_dir"]).select(*ASKED, order(F.col("h"), F.lit(False), {c: F.col(c) for c in ("distance", "archive_path")}).alias("b"))
    return nearest.unionByName(exact).groupBy(*ASKED).agg(F.min("b").alias("b")).select(*ASKED, F.col("b.archive_path").alias("target_path"))


def lookups(links: DataFrame) -> DataFrame:
    """``links`` (src_path, url, kind) with lookup, ts_dir and host, which name their resolution; lookup is null for what isn't looked up."""
    w, c = F.col("_w"), F.col("_c")
    found = links.withColumn("_w", F.when(F.col("kind") == "wayback", wayback_lookup(F.col("url")))).withColumn("_c", F.when(F.col("kind") == "root", page_context(F.col("src_path"))))
    lookup = strip_query(F.when(F.col("kind") == "wayback", w["lookup"]).when((F.col("kind") == "absolute") | c.isNotNull(), F.col("url")))
    folder = F.coalesce(F.concat(w["ts"], w["flags"]), F.concat(c["ts"], c["flags"]), F.lit(""))
    return found.select(*links.columns, lookup.alias("lookup"), folder.alias("ts_dir"), F.coalesce(c["host"], F.lit("")).alias("host"))


def destinations(links: DataFrame, best: DataFrame) -> DataFrame:
    """``links`` (src_path, url, kind; kinds absolute, wayback and root) with lookup, ts_dir, host, target_path and how: from the index, else a computed fallback."""
    asked = lookups(links)
    joined = asked.join(merged(resolve(asked.filter("lookup IS NOT NULL"), best)), ASKED, "left")
    beside = F.concat(F.lit("https/web.archive.org/web/"), "ts_dir", F.lit("/"), "host", "lookup")
    fallback = F.when(F.col("kind") == "root", beside).otherwise(fallback_path(F.when(F.col("kind") == "wayback", F.col("url")).otherwise(F.col("lookup"))))
    joined = joined.withColumn("_fallback", fallback)
    how = F.when(F.col("target_path").isNotNull(), "index").when(F.col("_fallback").isNotNull(), "fallback")
    return joined.select(*asked.columns, F.coalesce("target_path", "_fallback").alias("target_path"), how.alias("how"))


def _of_kind(links: DataFrame, kind: str, index: DataFrame, target: int) -> DataFrame:
    source = F.col("src_path") if kind == "root" else F.lit("").alias("src_path")
    return destinations(links.select(source, "url", F.lit(kind).alias("kind")).distinct(), best_captures(index, target))


def resolve_links(links: DataFrame, index: DataFrame, target: int) -> DataFrame:
    """(url, target_path, how) of distinct absolute links: from the index, else a computed fallback."""
    return _of_kind(links, "absolute", index, target).select("url", "target_path", "how")


def resolve_wayback_paths(links: DataFrame, index: DataFrame, target: int) -> DataFrame:
    """(url, target_path, how) of distinct /web/<ts><flags>/<rest> links."""
    return _of_kind(links, "wayback", index, target).filter("lookup IS NOT NULL").select("url", "target_path", "how")


def resolve_root_relative(links: DataFrame, index: DataFrame, target: int) -> DataFrame:
    """(ts_dir, host, url, target_path, how) of distinct root-relative links of Wayback pages; ``links`` has src_path and url."""
    pages = links.select("src_path", "url").withColumn("c", page_context(F.col("src_path"))).filter("c IS NOT NULL")
    # One page of each folder and host will do for all.
    one = pages.groupBy("c.ts", "c.flags", "c.host", "url").agg(F.min("src_path").alias("src_path"))
    return _of_kind(one, "root", index, target).select("ts_dir", "host", "url", "target_path", "how")


def request_path(url: Column) -> Column:
    """A request's path in the tree as folded segments: schemes and ports are folders, names sanitised, case ignored."""
    text = F.regexp_replace(F.regexp_replace(url, "^https://", "https/"), "^http://", "http/")
    port = F.regexp_extract(text, r":\d+", 0)
    at = F.instr(text, port)
    text = F.when(port != "", F.concat(text.substr(F.lit(1), at - 1), F.lit("/"), port.substr(F.lit(2), F.length(port)), text.substr(at + F.length(port), F.length(text)))).otherwise(text)
    return F.transform(F.filter(F.split(text, "/"), lambda s: (s != "") & (s != ".")), lambda s: F.lower(sanitize(s)))


def nearest_snapshot(requests: DataFrame, captures: DataFrame, distance: str = "numeric") -> DataFrame:
    """(ts_dir, archive_path, how) for each request (request_id, ts, url); null where nothing is captured.

    A capture in the folder that is named like the request's ts comes first. Else the timestamp with
    the smallest numeric distance wins, of equal ones the first folder by name. Only captures of paths that
    are asked for are put in order; a path's captures are in chunks by time, of which a request meets one,
    so that the work for a path is linear in its requests and captures, and a hot path spans several tasks.

    ``distance`` "numeric" compares timestamps as numbers, so that a month counts as much as a hundred
    days; "chronological" compares elapsed time.
    """
    number = numbered(distance)
    asked = asked_snapshots(requests, number)
    found = snapshots(captures, number).join(asked.select("fold").distinct(), "fold", "left_semi")
    return snapshots_found(requests, Lookup([chunked(found)], None, None).nearest(asked))


def numbered(distance: str):
    return ts_number if distance == "numeric" else lambda ts: F.coalesce(ts_seconds(ts), F.lit(0))


def asked_snapshots(requests: DataFrame, number=ts_number) -> DataFrame:
    """(request_id, req_dir, ts_num, fold) of requests (request_id, ts, url) that name a path."""
    rest = F.regexp_replace(F.regexp_replace("url", "(?i)^https?://", ""), "(?i)^https?/|^ftp/", "")
    return requests.select("request_id", F.col("ts").alias("req_dir"), number(F.col("ts")).alias("ts_num"), F.array_join(request_path(rest), "/").alias("fold")).filter("fold <> ''")


def snapshots_found(requests: DataFrame, nearest: DataFrame) -> DataFrame:
    """(request_id, ts_dir, archive_path, how) of all ``requests`` by what ``Lookup.nearest`` has for some."""
    how = F.when(F.col("elsewhere"), "nearest").when(~F.col("elsewhere"), "exact")
    return requests.select("request_id").join(nearest, "request_id", "left").select("request_id", "ts_dir", "archive_path", how.alias("how"))


def asked_files(requests: DataFrame) -> DataFrame:
    """(request_id, attempt, fold): the folded paths that requests (request_id, url) for files are tried under."""
    parts = request_path(F.col("url"))
    other_hosts = lambda p: F.when(
        F.get(p, F.lit(0)).isin("http", "https") & (F.size(p) > 1),
        F.transform(F.array_distinct(F.array(F.get(p, F.lit(1)), F.concat(F.lit("www."), F.get(p, F.lit(1))), F.regexp_replace(F.get(p, F.lit(1)), r"^www\.", ""))), lambda h: F.concat(F.array(F.get(p, F.lit(0)), h), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))),
    ).otherwise(F.array(p))
    asked = requests.select("request_id", parts.alias("p"))
    first = F.transform(F.when(F.size("p") == 0, F.array(F.array(F.lit("index.html")))).otherwise(other_hosts(F.col("p"))), lambda x: F.struct(F.lit(0).alias("attempt"), F.array_join(x, "/").alias("fold")))
    under_http = F.concat(F.array(F.lit("http")), F.col("p"))
    second = F.transform(
        F.when(F.size("p") == 0, F.array(F.array(F.lit("default.htm")))).when(~F.coalesce(F.get("p", F.lit(0)).startswith("http"), F.lit(False)), other_hosts(under_http)).otherwise(F.array().cast("array<array<string>>")),
        lambda x: F.struct(F.lit(1).alias("attempt"), F.array_join(x, "/").alias("fold")),
    )
    return asked.select("request_id", F.explode(F.concat(first, second)).alias("k")).select("request_id", "k.attempt", "k.fold")


def files_found(probes: DataFrame, stored: DataFrame) -> DataFrame:
    """(request_id, archive_path) of the first of ``asked_files`` that is among ``stored`` (fold, variant, archive_path)."""
    best = stored.groupBy("fold").agg(F.min(F.struct("variant", "archive_path")).alias("v")).select("fold", "v.*")
    hits = probes.join(best, "fold").groupBy("request_id").agg(F.min(F.struct("attempt", "variant", "archive_path")).alias("b"))
    return hits.select("request_id", F.col("b.archive_path").alias("archive_path"))


def smart_find(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """(request_id, archive_path) of requests (request_id, url) for files anywhere in the tree.

    Case doesn't count; a folder stands for its index.html; under http and https a host matches with
    and without www.; a path that doesn't begin with http is tried under http last. An empty path is
    the root's index.html, else default.htm.
    """
    return requests.select("request_id").join(files_found(asked_files(requests), files(captures)), "request_id", "left")
