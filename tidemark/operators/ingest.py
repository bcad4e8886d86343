"""URL lists, what of them is still to fetch, and the fetch itself."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import MAX_SEGMENT, inferred_ext, sanitize
from ..functions.urls import decoded_names, storage_path

#: Redirects followed at most; tasks that fetch, requests that each has under way at most, and those to one host.
MAX_REDIRECTS, TASKS, EACH, PER_HOST = 5, 2, 4, 4
#: Variants of one path that a fetcher holds at a time.
VARIANTS = 1000
# Seconds that a request may take, and what it says of itself.
TIMEOUT = 30
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/90.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/webp,image/apng,*/*;q=0.8",
}


def load_urls(lines: DataFrame) -> DataFrame:
    """(line_no, url): trimmed lines (line_no, line) without empty ones, comments and screenshots; the first of equal ones."""
    url = F.regexp_replace("line", r"^[\s ﻿]+|[\s ﻿]+$", "")
    kept = lines.select("line_no", url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#") & ~F.col("url").contains("/screenshot/"))
    return kept.groupBy("url").agg(F.min("line_no").alias("line_no")).select("line_no", "url")


def pending(urls: DataFrame, done: DataFrame, captures: DataFrame) -> DataFrame:
    """(line_no, url, dest) of URLs that have a storage path and are neither done nor stored with content."""
    left = urls.join(done.select("url"), "url", "left_anti").withColumn("dest", storage_path(F.col("url"))).filter("dest IS NOT NULL")
    stored = captures.filter("size > 0").select(F.explode(F.array(F.col("archive_path"), F.regexp_replace("archive_path", "/index\\.html$", ""))).alias("dest")).distinct()
    return left.join(stored, "dest", "left_anti").select("line_no", "url", "dest")


def path_collisions(urls: DataFrame) -> DataFrame:
    """(dest, n_urls, first_url) of storage paths that several URLs share; only the first is ever stored."""
    placed = urls.select("line_no", "url", storage_path(F.col("url")).alias("dest")).filter("dest IS NOT NULL")
    return placed.groupBy("dest").agg(F.count("*").alias("n_urls"), F.min_by("url", "line_no").alias("first_url")).filter("n_urls > 1")


def name_mapping(urls: DataFrame) -> DataFrame:
    """(short, original) of path segments (of ``url``) that are too long for a file name; the first URL's of equal ones."""
    names = urls.select("line_no", F.explode(decoded_names(F.col("url"))).alias("name")).filter(F.length("name") > MAX_SEGMENT)
    kept = names.select("line_no", sanitize(F.col("name")).alias("short"), F.regexp_replace("name", r'[<>:"/\\|?*]', "_").alias("original"))
    return kept.groupBy("short").agg(F.min_by("original", "line_no").alias("original"))


def redirected(url: str, location: str) -> str:
    """Where a redirect leads, as ``redirect_target`` has it for columns."""
    from urllib.parse import urlsplit

    at = urlsplit(url)
    origin = f"{at.scheme}://{at.netloc}"
    if location.startswith("//"):
        return f"{at.scheme}:{location}"
    if location.startswith("/"):
        return origin + location
    if location.startswith("http"):
        return location
    return f"{origin}{re.sub('/[^/]*/?$', '', at.path or '/') or '/'}/{location}"


def http_get(url: str) -> tuple[int, dict, bytes]:
    """One GET over HTTP: status, headers by lower-case name, and the body; redirects are not followed."""
    from urllib.error import HTTPError
    from urllib.request import HTTPRedirectHandler, Request, build_opener

    class Stay(HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    try:
        answer = build_opener(Stay).open(Request(url, headers=HEADERS), timeout=TIMEOUT)
    except HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""
    with answer:
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()


def _one(get, url: str) -> tuple[int, str, str | None, bytes | None]:
    """Status, content type, error and content of a URL, with redirects followed."""
    at, status, headers, body = url, 0, {}, b""
    try:
        for _ in range(MAX_REDIRECTS + 1):
            status, headers, body = get(at)
            if not (300 <= status < 400 and headers.get("location")):
                break
            at = redirected(at, headers["location"])
        else:
            return status, "", "too many redirects", None
        error = f"HTTP {status}" if status != 200 else None if body else "empty"
    except Exception as e:  # a fetcher may fail in any way; the URL stays to be fetched
        return status, headers.get("content-type", ""), str(e), None
    return status, headers.get("content-type", ""), error, None if error else body


class _Pool:
    """Fetches paths side by side: the variants of one path one after the other, until one succeeds."""

    def __init__(self, get, each: int, per_host: int):
        from collections import defaultdict
        from concurrent.futures import ThreadPoolExecutor
        from threading import BoundedSemaphore

        self.get, self.each, self.pool = get, each, ThreadPoolExecutor(each)
        self.hosts = defaultdict(lambda: BoundedSemaphore(per_host))
        self.under_way = {}

    def _path(self, host, rows, before):
        if before is not None and before.result()[1]:
            return [], True
        tried = []
        for url, dest in rows:
            with host:
                tried.append((url, dest, *_one(self.get, url)))
            if tried[-1][4] is None:
                return tried, True
        return tried, False

    def results(self, rows):
        """Tried (url, dest, status, content_type, error, content), in any order; ``rows`` (host, key, url, dest) have equal keys together."""
        from itertools import groupby
        from operator import itemgetter

        for (host, key), own in groupby(rows, itemgetter(0, 1)):
            before = None
            while some := [r[2:] for _, r in zip(range(VARIANTS), own, strict=False)]:
                while len(self.under_way) >= self.each:
                    yield from self._settled()
                before = self.pool.submit(self._path, self.hosts[host], some, before)
                self.under_way[before] = key
        while self.under_way:
            yield from self._settled()
        self.pool.shutdown()

    def _settled(self):
        from concurrent.futures import FIRST_COMPLETED, wait

        for f in wait(self.under_way, return_when=FIRST_COMPLETED).done:
            del self.under_way[f]
            yield from f.result()[0]


def path_key(dest):
    """What URLs with one place in the tree have in common: a folder's index.html is at the folder's place."""
    return F.regexp_replace(dest, "/index\\.html$", "")


def fetch(plan: DataFrame, get: Callable[[str], tuple[int, dict, bytes]] = http_get, tasks: int = TASKS, each: int = EACH, per_host: int = PER_HOST) -> DataFrame:
    """(url, dest, status, error, content) of the URLs of a plan (url, dest; line_no, where there is one, is their order) that were tried.

    ``get`` returns a status, headers and a body for one URL; it is called on the executors, by ``tasks`` tasks with
    ``each`` requests at a time. All of a host's URLs are in one task, so that ``per_host`` holds for all. Of URLs with
    one place in the tree the first is tried, and the next where it fails. Redirects are followed up to a limit; an empty
    body is an error. What has an error has no content.
    """

    def run(frames):
        rows = (r for frame in frames for r in zip(frame["host"], frame["key"], frame["url"], frame["dest"], strict=True))
        for r in _Pool(get, each, per_host).results(rows):
            yield pd.DataFrame([r], columns=["url", "dest", "status", "content_type", "error", "content"])

    order = F.col("line_no") if "line_no" in plan.columns else F.lit(0)
    dealt = plan.select("url", "dest", order.cast("long").alias("line_no"), F.get(F.split("dest", "/"), F.lit(1)).alias("host"), path_key(F.col("dest")).alias("key"))
    dealt = dealt.repartition(tasks, "host").sortWithinPartitions("host", "key", "line_no", "url")
    got = dealt.select("host", "key", "url", "dest").mapInPandas(run, "url string, dest string, status int, content_type string, error string, content binary")
    return got.select("url", inferred_ext(F.col("dest"), F.col("content_type")).alias("dest"), "status", "error", "content")
