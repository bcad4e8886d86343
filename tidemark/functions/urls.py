"""URL functions as columns: parsing, index keys, storage paths and fallback paths.

Parsing covers the http, https and ftp schemes of the WHATWG URL standard, with hosts in their normal form
(``hosts.py``); what lies outside, such as other schemes, parses to null rather than to a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hosts, sql
from .hosts import normal_host
from .paths import DOT, let, needs_html_suffix, sanitize, strip_query
from .sql import regex

# Names that stand for a folder, the name of a stored folder, and the archive's own hosts.
DEFAULT_DOCS = ("index.html", "index.htm", "default.asp", "default.aspx", "default.htm", "default.html", "default.shtml", "index.shtml", "home.asp", "home.html", "main.html")
DIRECTORY_INDEX = "__wayback__directory_index.html"
INFRASTRUCTURE = ("archive.org", "web.archive.org", "web-static.archive.org", "analytics.archive.org", "polyfill.archive.org")

_SPECIAL = r"(?s)^(https?|ftp):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _encoded(text: str, keep: str) -> str:
    """Percent-encodes the characters of ``text`` (the name of a value) that aren't in the class ``keep``."""
    one = f"CASE WHEN sign rlike {regex(keep)} THEN sign WHEN sign = ' ' THEN '%20' ELSE url_encode(sign) END"
    return f"if({text} rlike {regex(f'(?s)^(?:{keep})*$')}, {text}, array_join(transform(split({text}, ''), sign -> {one}), ''))"


def _clean_path(path: str) -> str:
    """An absolute path without dot segments."""
    low = lambda s: f"regexp_replace(lower({s}), '%2e', '.')"
    kept = f"aggregate(segs, cast(array() AS array<string>), (acc, seg) -> CASE WHEN {low('seg')} = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN {low('seg')} = '.' THEN acc ELSE concat(acc, array(seg)) END)"
    end = f"if({low('element_at(segs, -1)')} IN ('.', '..'), array(''), cast(array() AS array<string>))"
    return sql.let(f"split({sql.without(path, r'^[/\\]')}, {regex(r'[/\\]')})", "segs", f"concat('/', array_join(concat({kept}, {end}), '/'))")


# A URL in its own normal form already: a lower-case host with a name at its end and no port, no segment
# that begins with a dot, nothing to encode.
_PLAIN = r"^(https?|ftp)://((?:[a-z0-9-]+\.)+[a-z][a-z-]*)((?:/(?!\.)[\w!$&()*+,;=:@~.-]*)*)(\?[\w!$&()*+,;=:@~./-]*)?(#[\w!$&()*+,;=:@~./-]*)?\z"


def _parsed(text: str) -> str:
    """The whole algorithm, of the name of a value."""
    trimmed = sql.without(sql.without(text, r"^[\x00-\x20]+|[\x00-\x20]+$"), r"[\t\n\r]")
    lowered = f"concat(lower({sql.part('tidy_url', r'^[^:]*', 0)}), {sql.part('tidy_url', r'(?s)^[^:]*(:.*)$', 1)})"
    cut = "named_struct('special', low_url rlike " + regex(_SPECIAL) + ", " + ", ".join(f"'p{i}', {sql.part('low_url', _SPECIAL, i)}" for i in range(1, 6)) + ")"
    host = sql.let(sql.without("authority", r":\d*$"), "host", f"if(x.special, {normal_host('host')}, null)")
    port = sql.without(sql.part("authority", r":(\d*)$", 1), r"^0+(?=\d)")
    good = "x.special AND at.host IS NOT NULL AND length(at.port) <= 5 AND coalesce(try_cast(at.port AS int), 0) <= 65535"
    default = "CASE x.p1 WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '21' END"
    path = sql.let(f"if(x.p3 = '', '/', {_clean_path('x.p3')})", "whole_path", _encoded("whole_path", r"[!#-;=@-_a-z|~]"))
    whole = f"""named_struct('protocol', x.p1, 'hostname', at.host, 'port', if(at.port = {default}, '', at.port), 'pathname', {path},
      'search', if(x.p4 = '?', '', {_encoded("x.p4", r"[!$-&(-;=?-~]")}), 'hash', if(x.p5 = '#', '', {_encoded("x.p5", r"[!#-;=?-_a-~]")}))"""
    parts = sql.let(sql.without("x.p2", r"^.*@"), "authority", sql.let(f"named_struct('host', {host}, 'port', {port})", "at", f"if({good}, {whole}, null)"))
    return sql.let(trimmed, "tidy_url", sql.let(lowered, "low_url", sql.let(cut, "x", parts)))


def _plain(text: str) -> str:
    get = lambda i: sql.part(text, _PLAIN, i)
    bare = lambda i, sign: f"if({get(i)} = '{sign}', '', {get(i)})"
    return f"named_struct('protocol', {get(1)}, 'hostname', {get(2)}, 'port', '', 'pathname', if({get(3)} = '', '/', {get(3)}), 'search', {bare(4, '?')}, 'hash', {bare(5, '#')})"


_PARSE_ANY = f"given -> {_parsed('given')}"
_PARSE = f"given -> if(given rlike {regex(_PLAIN)}, {_plain('given')}, {_parsed('given')})"


def parse(url: Column) -> Column:
    """(protocol, hostname, port, pathname, search, hash), or null where the URL has no parse.

    What is in normal form is cut by one expression; all else goes through the whole algorithm.
    """
    return sql.apply(_PARSE, url)


def parse_any(url: Column) -> Column:
    """As ``parse``, by the whole algorithm."""
    return sql.apply(_PARSE_ANY, url)


def parse_link(url: Column) -> Column:
    """As ``parse``, for a link in a page: // is promoted to http; what can't be resolved without a base is null."""
    promoted = F.when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(url)
    bad = url.rlike(r"(?i)^(javascript|data|mailto|blob|about):") | url.startswith("#") | (url.startswith("/") & ~url.startswith("//"))
    return F.when(~bad, parse(promoted))


def key(protocol: Column, host: Column, port: Column, path: Column) -> Column:
    """The index key of a URL: one leading slash of the path doesn't count."""
    return F.concat(protocol, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.lit("/"), F.regexp_replace(path, "^/", ""))


def www_toggled(host: Column) -> Column:
    return F.when(host.startswith("www."), host.substr(F.lit(5), F.length(host))).otherwise(F.concat(F.lit("www."), host))


def decoded_strictly(text: Column) -> Column:
    """``text`` with its percent signs decoded as UTF-8; null where one encodes nothing, or bytes that aren't UTF-8."""
    return sql.apply(f"given -> {hosts.decoded_strictly('given')}", text)


def _decoded(segment: Column) -> Column:
    return F.coalesce(decoded_strictly(segment), segment)


_WAYBACK_IN_URL = rf"/web/(\d{{4,14}})([a-z0-9_]+)?/({DOT}*)"


def decoded_names(url: Column) -> Column:
    """The decoded path segments of a URL; null where it has no parse."""
    full = F.when(url.rlike("^(http|ftp)"), url).otherwise(F.concat(F.lit("http://"), url))
    return let(parse(full), lambda u: F.transform(F.filter(F.split(u["pathname"], "/"), lambda s: s != ""), _decoded))


def storage_path(url: Column) -> Column:
    """Where a fetched URL is stored, or null where it has no parse."""

    def placed(x: Column) -> Column:
        return let(parse(x["full"]), lambda u: F.when(u.isNotNull(), _stored(u, x)))

    def split(base: Column) -> Column:
        wayback = base.rlike(_WAYBACK_IN_URL)
        ts_dir = F.concat(F.regexp_extract(base, _WAYBACK_IN_URL, 1), F.regexp_extract(base, _WAYBACK_IN_URL, 2))
        return F.struct(F.when(wayback, ts_dir).alias("ts_dir"), F.when(wayback, F.regexp_extract(base, _WAYBACK_IN_URL, 3)).otherwise(url).alias("raw"))

    full = lambda raw: F.when(raw.startswith("http"), raw).when(raw.startswith("ftp"), F.concat(F.lit("ftp://"), F.regexp_replace(raw, "^ftp://", ""))).otherwise(F.concat(F.lit("http://"), raw))
    return let(let(strip_query(url), split), lambda x: let(F.struct(x["ts_dir"].alias("ts_dir"), x["raw"].alias("raw"), full(x["raw"]).alias("full")), placed))


def _stored(u: Column, x: Column) -> Column:
    dots = lambda s: F.when(s == ".", "_").when(s == "..", "__").otherwise(s)
    names = F.transform(F.filter(F.split(u["pathname"], "/"), lambda s: s != ""), lambda s: let(_decoded(s), lambda d: sanitize(dots(d))))
    port = F.when(u["port"] != "", F.array(u["port"])).otherwise(F.array().cast("array<string>"))
    prefix = F.when(x["ts_dir"].isNotNull(), F.concat(F.lit("https/web.archive.org/web/"), x["ts_dir"])).otherwise(u["protocol"])

    def whole(parts: Column) -> Column:
        last = F.when(x["raw"].endswith("/"), F.array(F.lit(DIRECTORY_INDEX))).when(F.size(parts) <= 1, F.array(F.lit("index.html"))).otherwise(F.array().cast("array<string>"))
        return F.concat(prefix, F.lit("/"), F.array_join(F.concat(parts, last), "/"))

    return let(F.concat(F.array(sanitize(u["hostname"])), port, names), whole)


def _archive_path(prefix: Column, host: Column, path: Column) -> Column:
    """Prefix, host, port and path segments; index.html for a folder; .html by name."""

    def joined(named: Column) -> Column:
        # An extension counts only in a name of the path, not in a host.
        has_ext = (F.size(named) > 0) & F.coalesce(F.get(named, F.size(named) - 1), F.lit("")).rlike(r"\.[a-zA-Z0-9]{1,10}$")
        where = F.replace(F.lower(host), F.lit(":"), F.lit("/"))
        return F.concat_ws("/", prefix, where, F.when(F.size(named) > 0, F.array_join(named, "/")), F.when(~has_ext & path.endswith("/"), F.lit("index.html")))

    return let(let(F.filter(F.split(path, "/"), lambda s: s != ""), joined), lambda j: F.concat(j, F.when(needs_html_suffix(j, F.lit(False)), ".html").otherwise("")))


_WB_ABSOLUTE = rf"(?i)^(?:https?://(?:www\.)?web\.archive\.org)?/web/(\d{{4,14}})([a-z0-9_]*)/({DOT}+)$"
_REST = rf"(?i)^(?:(?:https?|ftp)(?:://|/(?=[^/])))?([^/]*)(/{DOT}*)?$"
_DIRECT = rf"(?i)^(https?|ftp)://([^/]+)(/{DOT}*)?$"
_PROTO_LESS = rf"(?i)^//([^/]+)(/{DOT}*)?$"


def fallback_path(url: Column) -> Column:
    """Where a URL would be stored in the archive, whether or not it is there; null if nowhere."""
    got = lambda pattern, i: F.regexp_extract(url, pattern, i)
    parts = lambda prefix, host, path: F.struct(prefix.alias("prefix"), host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))
    wayback = let(got(_WB_ABSOLUTE, 3), lambda rest: parts(F.concat(F.lit("https/web.archive.org/web/"), got(_WB_ABSOLUTE, 1), got(_WB_ABSOLUTE, 2)), F.regexp_extract(rest, _REST, 1), F.regexp_extract(rest, _REST, 2)))
    direct = parts(F.lower(got(_DIRECT, 1)), got(_DIRECT, 2), got(_DIRECT, 3))
    bare = parts(F.lit("http"), got(_PROTO_LESS, 1), got(_PROTO_LESS, 2))
    chosen = F.when(url.rlike(_WB_ABSOLUTE), wayback).when(url.rlike(_DIRECT), direct).when(url.rlike(_PROTO_LESS), bare)
    return let(chosen, lambda x: F.when(x.isNotNull(), _archive_path(x["prefix"], x["host"], x["path"])))


def wayback_lookup(path: Column) -> Column:
    """(ts, flags, lookup URL) of a /web/<ts><flags>/<rest> path, or null."""
    pattern = rf"(?i)^/web/(\d{{4,14}})([a-z0-9_]*)/({DOT}+)$"
    rest = F.regexp_extract(path, pattern, 3)
    proto, after = F.regexp_extract(rest, rf"(?i)^(https?|ftp)(?:://|/)({DOT}+)$", 1), F.regexp_extract(rest, rf"(?i)^(https?|ftp)(?:://|/)({DOT}+)$", 2)
    lookup = F.when(proto != "", F.concat(F.lower(proto), F.lit("://"), after)).otherwise(F.concat(F.lit("http://"), rest))
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).alias("ts"), F.regexp_extract(path, pattern, 2).alias("flags"), lookup.alias("lookup")))


def page_context(path: Column) -> Column:
    """(ts, flags, host) of a page stored as a Wayback capture, or null."""
    pattern = r"(?i)^(?:https?/)?web\.archive\.org/web/(\d{4,14})([a-z0-9_]*)/([^/]+)"
    return F.when(path.rlike(pattern), F.struct(*[F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "ts"), (2, "flags"), (3, "host"))]))


def link_kind(url: Column) -> Column:
    """How a link in a page is resolved: skip, relative, wayback, root or absolute."""
    return (
        F.when(url.startswith("#") | url.rlike(r"(?i)^(javascript|data|mailto|blob):"), "skip")
        .when(~url.rlike(r"(?i)^(https?:|ftp:|//|/)"), "relative")
        .when(url.rlike(r"(?i)^/web/\d{4,14}"), "wayback")
        .when(url.startswith("/") & ~url.startswith("//"), "root")
        .otherwise("absolute")
    )


def redirect_target(url: Column, location: Column) -> Column:
    """Where a redirect leads: a path from the origin, a name from the folder, or a URL of its own.

    A location that starts with // keeps the scheme alone.
    """

    def lead(u: Column) -> Column:
        origin = F.concat(u["protocol"], F.lit("://"), u["hostname"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))
        folder = F.regexp_replace(u["pathname"], r"/[^/]*/?$", "")
        folder = F.when(folder == "", "/").otherwise(folder)
        return (
            F.when(location.startswith("//"), F.concat(u["protocol"], F.lit(":"), location))
            .when(location.startswith("/"), F.concat(origin, location))
            .when(~location.startswith("http"), F.concat(origin, folder, F.lit("/"), location))
            .otherwise(location)
        )

    return let(parse(url), lead)
