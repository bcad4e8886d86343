"""Path, name and text functions as columns; paths are POSIX and relative to the archive root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's \s and . as Java patterns: they differ on U+00A0, U+FEFF and U+0085.
S = r"[\s ﻿]"
DOT = r"[^\n\r  ]"

# Name and extension sets.
INDEX_NAMES = ("index", "default", "home", "welcome", "main")
HTML_EXTENSIONS = (".html", ".htm", ".asp", ".aspx", ".php", ".cfm", ".cgi", ".jsp", ".shtml")
TEXT_EXTENSIONS = (*HTML_EXTENSIONS, ".css", ".js", ".txt", ".xml", ".svg")
NON_NATIVE_EXTENSIONS = (".asp", ".aspx", ".php", ".cfm", ".cgi", ".jsp", ".shtml")
SERVED_AS_HTML = (".html", ".htm", ".asp", ".php", ".aspx", ".cfm", ".shtml")
MIME_TYPES = {
    ".html": "text/html", ".htm": "text/html", ".asp": "text/html", ".aspx": "text/html", ".php": "text/html", ".cfm": "text/html", ".shtml": "text/html",
    ".css": "text/css", ".js": "application/javascript", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".ico": "image/x-icon", ".txt": "text/plain", ".bmp": "image/bmp", ".woff": "font/woff", ".woff2": "font/woff2", ".svg": "image/svg+xml",
}
ASSET_ENDINGS = ("css", "js", "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico", "woff", "woff2", "ttf", "eot", "json", "xml", "txt", "map")
ASSET_NAMES = ("css", "js", "style", "styles", "stylesheet", "script", "image", "img", "icon", "logo", "banner", "photo", "pic", "thumb", "sprite")

MAX_SEGMENT, KEPT_PREFIX = 200, 150


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def raw_ext_of(path: Column) -> Column:
    """From the name's last dot; empty for a dot file or a name without a dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def ext_of(path: Column) -> Column:
    return F.lower(raw_ext_of(path))


def stem_of(path: Column) -> Column:
    return F.regexp_extract(base_of(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def segments(path: Column) -> Column:
    """The path's segments without empty ones and dots; .. takes back the one before."""
    raw = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.aggregate(raw, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))


def relative(from_dir: Column, target: Column) -> Column:
    """The relative path from a folder to a file, beginning with a dot."""

    def rel(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        common = let(F.array_position(same, False).cast("int"), lambda at: F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1))
        return let(common, lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - n), F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0)))), "/"))

    joined = let(segments(from_dir), lambda a: let(segments(target), lambda b: rel(a, b)))
    return let(joined, lambda r: F.when(r.startswith("."), r).otherwise(F.concat(F.lit("./"), r)))


def sanitize(segment: Column) -> Column:
    """A URL segment as a file name: illegal signs as _, long names cut and hashed."""

    def cut(safe: Column) -> Column:
        short = F.concat(F.substring(safe, 1, KEPT_PREFIX), F.lit("_"), F.substring(F.md5(safe.cast("binary")), 1, 8), raw_ext_of(safe))
        return F.when(F.length(safe) > MAX_SEGMENT, short).otherwise(safe)

    return let(F.regexp_replace(segment, r'[<>:"/\\|?*]', "_"), cut)


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, rf"[?#]{DOT}*$", "")


def hash_of(url: Column) -> Column:
    at = F.instr(url, "#")
    return F.when(at > 0, url.substr(at, F.length(url))).otherwise("")


def is_index_name(path: Column) -> Column:
    return (ext_of(path) == "") & F.lower(base_of(path)).isin(*INDEX_NAMES)


def is_text_file(path: Column) -> Column:
    return ext_of(path).isin(*TEXT_EXTENSIONS) | is_index_name(path)


def is_html_file(path: Column) -> Column:
    return ext_of(path).isin(*HTML_EXTENSIONS) | is_index_name(path)


def is_web_page(path: Column) -> Column:
    """A page for the catalogue of an archive: screenshots never are."""
    return ~path.contains("screenshot") & is_html_file(path)


def is_flat_web_page(path: Column) -> Column:
    """A page of a flattened tree, where pages of server-side types end with .html."""
    return ~base_of(path).contains("screenshot") & (ext_of(path).isin(".html", ".htm") | is_index_name(path))


def content_is_html(content: Column) -> Column:
    """Whether <html stands in the first 4096 bytes."""
    return F.decode(F.substring(content, 1, 4096), "ISO-8859-1").rlike("(?i)<html")


def needs_html_suffix(path: Column, sniffed: Column) -> Column:
    """Whether a file of a server-side type gets .html appended, by content or by name."""
    name = base_of(path)

    def by_name(raw: Column) -> Column:
        ext = F.lower(raw)
        # The stem loses the extension only where it is written in lower case.
        stem = F.lower(F.when(raw == ext, name.substr(F.lit(1), F.length(name) - F.length(ext))).otherwise(name))
        asset = let(stem, lambda s: s.rlike(rf"\.({'|'.join(ASSET_ENDINGS)})$") | s.isin(*ASSET_NAMES))
        return ext.isin(*NON_NATIVE_EXTENSIONS) & ~asset

    return F.coalesce(sniffed, F.lit(False)) | let(raw_ext_of(path), by_name)


def mime_type(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(types, ext_of(path)), F.lit("application/octet-stream"))


def charset(content: Column) -> Column:
    """The charset that a page's own meta element declares in its first 8192 bytes, or null."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    equiv = F.regexp_extract(head, rf"""(?i)<meta[^>]+http-equiv{S}*={S}*["']?content-type["']?[^>]*content{S}*={S}*["'][^"']*charset{S}*={S}*["']?([a-zA-Z0-9\-_]+)""", 1)
    plain = F.regexp_extract(head, rf"""(?i)<meta[^>]+charset{S}*={S}*["']?([a-zA-Z0-9\-_]+)""", 1)
    return F.coalesce(F.nullif(equiv, F.lit("")), F.nullif(plain, F.lit("")))


def ts_number(ts: Column) -> Column:
    """Leading digits of a timestamp, padded with zeros or cut to 14, as a number; null has 0."""
    digits = F.regexp_extract(F.coalesce(ts, F.lit("")), r"^(\d+)", 1)
    return F.when(digits != "", F.rpad(digits, 14, "0").cast("long")).otherwise(F.lit(0).cast("long"))


def ts_seconds(ts: Column) -> Column:
    """A timestamp of 4 to 14 digits as seconds since 1970; what it leaves out is the earliest there is."""

    def seconds(t: Column) -> Column:
        part = lambda at, least: F.greatest(F.substring(t, at, 2), F.lit(least))
        return F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(t, 1, 4), part(5, "01"), part(7, "01"), F.substring(t, 9, 6)), F.lit("yyyyMMddHHmmss")))

    return let(F.rpad(F.regexp_extract(F.coalesce(ts, F.lit("")), r"^(\d+)", 1), 14, "0"), seconds)


def date_number(date: Column, today: str) -> Column:
    """YYYY[-MM[-DD]] as a 14-digit number; null or empty is ``today``, an argument so that results repeat."""
    given = F.when(F.coalesce(date, F.lit("")) == "", F.lit(today)).otherwise(date)
    part = lambda i, default: F.coalesce(F.nullif(F.get(F.split(given, "-"), F.lit(i)), F.lit("")), F.lit(default))
    return F.concat(part(0, "2000"), F.lpad(part(1, "01"), 2, "0"), F.lpad(part(2, "01"), 2, "0"), F.lit("000000")).cast("long")


def catalogue_size(size: Column) -> Column:
    return F.concat(F.ceil(size / 1024).cast("string"), F.lit("KB"))


def listing_size(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))


def inferred_ext(path: Column, content_type: Column) -> Column:
    """Where a fetched file goes: a path without an extension gets one by its content type."""
    t = F.coalesce(content_type, F.lit(""))
    more = F.when(t.contains("text/html"), "/index.html")
    for word, ext in (("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/gif", ".gif"), ("javascript", ".js"), ("css", ".css")):
        more = more.when(t.contains(word), ext)
    return F.when(raw_ext_of(path) == "", F.concat(path, more.otherwise(""))).otherwise(path)


def path_inside(child: Column, parent: Column) -> Column:
    """Whether a path is its parent or lies inside it, after .. and . are resolved."""
    c, p = segments(child), segments(parent)
    return (F.size(p) == 0) | ((F.size(c) >= F.size(p)) & (F.array_join(F.slice(c, 1, F.greatest(F.size(p), F.lit(1))), "/") == F.array_join(p, "/")))
