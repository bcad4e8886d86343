"""Inputs of the queries, derived from the table of pages: the same formulas as in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.captures import from_pages

#: The date that links are resolved for.
TARGET = 20080101000000

#: What an archive injects into a page, and links of every form.
INJECTED = (
    '<!-- BEGIN WAYBACK TOOLBAR INSERT --><div>bar</div><!-- END WAYBACK TOOLBAR INSERT --><script src="/js/athena.js"></script><script>window.RufflePlayer={}</script>'
    '<base href="http://x.com/"><a HREF = \'/img/a.gif\'>a</a><a href="https://web.archive.org/web/20050101/http://x.com/b">b</a><img src="http://archive.org/logo.png">'
    "<style>p{background:url( '/img/c.png' )}\n@import \"/css/d.css\";</style><script>var u='//web.archive.org/web/2005im_/http://x.com/e.js';var s='https://web-static.archive.org/_static/f.css'</script>"
)

#: Hosts as URLs may have them, and in normal form; None where there is none.
HOSTS = (
    ("münchen.de", "xn--mnchen-3ya.de"), ("BÜCHER.example", "xn--bcher-kva.example"), ("例え。テスト", "xn--r8jz45g.xn--zckzah"), ("ＥＸ.com", "ex.com"), ("%61.com", "a.com"), ("m%C3%BCnchen.de", "xn--mnchen-3ya.de"),
    ("127.1", "127.0.0.1"), ("0x7f000001", "127.0.0.1"), ("0177.0.0.01", "127.0.0.1"), ("3232235777", "192.168.1.1"), ("256.1", None), ("[::1]", "[::1]"), ("[2001:DB8:0:0:1:0:0:1]", "[2001:db8::1:0:0:1]"), ("[::FFFF:1.2.3.4]", "[::ffff:102:304]"), ("[1::2::3]", None), ("a%FF.com", None), ("a b.com", None),
)

#: Marks that archives leave, one for each way; and whether the flattener and the server take them out. The last ones are a page's own.
MARKS = (
    ("<!-- BEGIN WAYBACK TOOLBAR INSERT -->\n<b>x</b>\n<!-- END WAYBACK TOOLBAR INSERT -->", True, True), ("<SCRIPT type='a' src='//archive.example/js/athena.js'>\n</SCRIPT>", True, True),
    ("<script>window.addEventListener('DOMContentLoaded',function(){var v=archive_analytics.values;archive_analytics.send_pageview({});});</script>", True, True), ("<script>\n window.RufflePlayer=window.RufflePlayer||{};\n</script>", True, True),
    ('<script type="t" src="/_static/js/ruffle/ruffle.js"></script>', True, True), ('<script src="/_static/js/wombat.js?v=txqj7nKC" charset="utf-8"></script>', True, False), ('<script src="/_static/js/bundle-playback.js?v=1"></script>', True, False),
    ('<script type="t">\n<!-- \n __wm.init("/web");\n</script>', True, False), ('<script>__wm.wombat("http://x","2001","/","web");</script>', True, False), ("<BASE  target=_top>", True, False), ("<base>", True, False), ("<!-- End Wayback Rewrite JS Include -->", True, True),
    ('<script src="//archive.org/includes/analytics.js?v=1"></script>', True, False), ("<link rel='x' href='https://www.archive.org/a.css' />", True, False),
    ("<script src='/js/own.js'></script>", False, False), ("<script>window.other=1</script>", False, False), ("<basefont size=2>", False, False), ("<!-- BEGIN OTHER INSERT --><!-- END OTHER INSERT -->", False, False), ("<link href='/own.css'>", False, False),
)

ENDINGS = (".asp", ".css.asp", ".php", ".html", "", ".JS", "/index.html", ".jsp")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def other_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url): pages under one of HOSTS each, some with a port, and with a name that isn't UTF-8 or is."""
    spelling = F.element_at(F.array(*[F.lit(h) for h, _ in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    port = F.when(F.col("page_id") % 3 == 0, ":8080").when(F.col("page_id") % 3 == 1, ":80").otherwise("")
    return pages(spark, sf_dir).select("page_id", F.concat(F.lit("http://"), spelling, port, F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/%FF.html").otherwise("/%C3%A9.html")).alias("url"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_pages(pages(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct captures of all pages with endings of many types, and static assets of some."""
    p = pages(spark, sf_dir)
    path = F.concat(F.lit("http/"), F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://|/$", ""), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 8 + 1).cast("int")))
    static = F.concat(F.lit("https/web-static.archive.org/_static/js/"), F.col("page_id").cast("string"), F.lit(".js"))
    content = F.when(F.col("page_id") % 3 == 0, F.lit("body { color: red }")).otherwise(F.col("html")).cast("binary")
    columns = [F.octet_length(content).cast("long").alias("size"), F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") * 60).alias("mtime"), content.alias("content")]
    return p.select(path.alias("archive_path"), *columns).unionByName(p.filter("page_id % 10 = 0").select(static.alias("archive_path"), *columns))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL list with blanks, comments, repeated and screenshot lines."""
    p = pages(spark, sf_dir)
    each = F.array(
        F.concat(F.lit(" "), "url", F.lit("\t")), F.concat(F.lit("# "), "url"),
        F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/screenshot/x"))).otherwise(F.col("url")), F.lit(""),
    )
    return p.select("page_id", F.posexplode(each).alias("k", "line")).select((F.col("page_id") * 4 + F.col("k")).alias("line_no"), "line")


def snapshot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, ts, url): three dates for every page, with hosts in either case."""
    p = pages(spark, sf_dir).select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    day = F.date_add(F.lit("2003-01-01").cast("date"), (F.pmod(F.col("page_id") * 53, F.lit(7000)) + F.col("k") * 777).cast("int"))
    ts = F.substring(F.date_format(day, "yyyyMMdd"), 1, 4 + 2).cast("string")
    return p.select((F.col("page_id") * 3 + F.col("k")).alias("request_id"), F.concat(ts, F.when(F.col("k") == 2, "id_").otherwise("")).alias("ts"), F.when(F.col("k") == 1, F.upper("rest")).otherwise(F.col("rest")).alias("url"))


def paths_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, path): requests of all routes."""
    p = pages(spark, sf_dir).withColumn("bare", F.regexp_replace("url", "^[a-z]+://", "")).withColumn("id", F.col("page_id").cast("string"))
    each = F.array(
        F.concat(F.lit("/web/2005"), F.lpad(F.pmod("page_id", F.lit(12)) + 1, 2, "0"), F.lit("/"), "url"), F.concat(F.lit("/https/web.archive.org/web/20041231im_/"), "bare"),
        F.concat(F.lit("/_static/js/"), "id", F.lit(".js?v=1")), F.concat(F.lit("http://localhost:8080/http/"), "bare"), F.when(F.col("page_id") == 0, "/index.html").otherwise(F.concat(F.lit("/missing/"), "id")),
    )
    return p.select("page_id", F.posexplode(each).alias("k", "path")).select((F.col("page_id") * 5 + F.col("k")).alias("request_id"), "path")


def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links to every page, some with the other scheme, with or without www., or with neither."""
    p = pages(spark, sf_dir)
    other = F.when(F.col("url").startswith("https:"), F.concat(F.lit("http:"), F.expr("substr(url, 7)"))).otherwise(F.concat(F.lit("https:"), F.expr("substr(url, 6)")))
    www = F.regexp_replace("url", "^([a-z]+)://(?:www\\.)?", "$1://www.")
    none = F.regexp_replace("url", "^[a-z]+:", "")
    return p.select(F.element_at(F.array("url", other, www, none), (F.col("page_id") % 4 + 1).cast("int")).alias("url"))


def wayback_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/web/ links to all pages: every second one to a date of its own captures."""
    c = captures(spark, sf_dir).filter("archive_path LIKE 'https/web.archive.org/%'")
    ts, rest = F.regexp_extract("archive_path", r"/web/([^/]*)/", 1), F.regexp_extract("archive_path", r"/web/[^/]*/(.*)$", 1)
    exact = F.substring(ts, 14, 1).try_cast("int") % 2 == 0
    return c.select(F.concat(F.lit("/web/"), F.when(exact, ts).otherwise(F.lit("2010")), F.lit("/http://"), rest, F.lit("?q=1#top")).alias("url"))


def root_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_path, url): root-relative links of Wayback pages to a page of the same host, and to nothing."""
    c = captures(spark, sf_dir).filter("archive_path LIKE 'https/web.archive.org/%'").select("archive_path")
    path = F.concat(F.lit("/"), F.regexp_extract("archive_path", r"/web/[^/]*/[^/]*/?(.*)$", 1))
    return c.select(F.col("archive_path").alias("src_path"), F.explode(F.array(path, F.lit("/missing/a.asp?x=1#y"))).alias("url"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what an archive injects, links of every form, and a link to the page itself."""
    own = F.concat(F.lit('<a href="http://'), F.regexp_replace("archive_path", r"^https/web\.archive\.org/web/[^/]*/|^[a-z]+/", ""), F.lit('#top">own</a>'))
    content = F.encode(F.concat(F.decode("content", "ISO-8859-1"), F.lit(INJECTED), own), "ISO-8859-1")
    return captures(spark, sf_dir).withColumn("content", content).withColumn("archive_path", F.concat(F.regexp_replace("archive_path", r"/$|\.html$", ""), F.lit(".html")))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text): pages with one of MARKS each in their middle."""
    piece = F.element_at(F.array(*[F.lit(m) for m, _, _ in MARKS]), (F.col("page_id") % len(MARKS) + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", F.concat(F.lit("<p>"), F.col("page_id").cast("string"), piece, F.lit("</p>"), "html").alias("text"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived style sheets, scripts, images and pages of a server-side type."""
    c = captures(spark, sf_dir).filter("archive_path LIKE 'https/web.archive.org/%'")
    kind = F.pmod(F.length("archive_path"), F.lit(4))
    ending = F.element_at(F.array(*map(F.lit, (".css", ".js", ".gif", ".php"))), (kind + 1).cast("int"))
    text = F.element_at(F.array(F.lit("body{background:url( '/img/a.png' )}\n@import \"/css/b.css\";"), F.lit('var u="/web/2001im_/http://y.com/z.js";'), F.lit("GIF89a url(/x)"), F.lit('<html><a href="x.htm">')), (kind + 1).cast("int"))
    return c.withColumn("content", text.cast("binary")).withColumn("archive_path", F.concat(F.regexp_replace("archive_path", r"/$", ""), ending))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for every page, of which some are empty, and some have a path that would lead out of the tree."""
    n = F.col("page_id").cast("string")
    path = F.concat(F.when(F.col("page_id") % 11 == 0, "../").otherwise("./"), F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("//"), n, F.lit(".html"))
    return pages(spark, sf_dir).select(path.alias("path"), F.when(F.col("page_id") % 13 == 0, "").otherwise(F.col("html")).cast("binary").alias("content"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, value): configurations, some without a location and some that can't be parsed."""
    named = F.concat(F.lit('{"currentSaveLocation": "'), F.when(F.col("page_id") % 2 == 0, "__USER_DOCUMENTS__/").otherwise("/data/"), F.col("page_id").cast("string"), F.lit('"}'))
    return pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 5 == 3, '{"other": 1}').when(F.col("page_id") % 5 == 4, "{broken").otherwise(named).alias("value"))


def answers():
    """A getter without a network, whose answer follows from the length of the URL before its query: missing, moved, or a page.

    Made here, so that workers get it by value.
    """

    def get(url):
        size = len(url.split("?")[0].split("#")[0])
        if url.endswith("/moved"):
            return 200, {"content-type": "text/css"}, url.encode()
        if size % 3 == 0:
            return 404, {}, b""
        if size % 3 == 1:
            return 302, {"location": "/moved"}, b""
        return 200, {"content-type": "text/plain"}, url.encode()

    return get
