"""DuckDB SQL with the same rows as the queries, for those that SQL can express.

The SQL is written from what the operators mean, for the forms that occur in the tables, and not from
how Spark computes them. Where DuckDB's regular expressions differ (no look-behind, no
back-references) it says the same in another way.
"""

from __future__ import annotations

from ..functions.paths import ASSET_ENDINGS, ASSET_NAMES, HTML_EXTENSIONS, INDEX_NAMES, MIME_TYPES, NON_NATIVE_EXTENSIONS, SERVED_AS_HTML, TEXT_EXTENSIONS
from ..functions.urls import DEFAULT_DOCS, DIRECTORY_INDEX, INFRASTRUCTURE
from .fixtures import ENDINGS, HOSTS, INJECTED, MARKS, TARGET


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


CAPTURES = """
snap AS (
  SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS rest,
    unnest(CASE WHEN page_id % 5 = 0 THEN [-1] ELSE range(0, page_id % 4 + 1) END) AS k FROM pages
), captures AS (
  SELECT page_id, html, k, CASE WHEN k < 0 THEN replace(rest, '://', '/') ELSE 'https/web.archive.org/web/' ||
    strftime(TIMESTAMP '2001-01-01' + to_days(CAST(page_id * 37 % 8000 + k * 101 AS INTEGER)) + to_seconds(page_id * 7919 % 86400), '%Y%m%d%H%M%S') ||
    ['', 'id_', 'cs_', 'im_'][k + 1] || '/' || regexp_replace(rest, '^[a-z]+://', '') END AS archive_path,
    CAST(strlen(html) AS BIGINT) AS size, TIMESTAMP '2023-11-14 22:13:20' + to_minutes(page_id) AS mtime
  FROM snap
), seg AS (SELECT *, string_split(archive_path, '/') AS p, k >= 0 AS is_wayback FROM captures)"""

CLASSIFIED = (
    CAPTURES
    + r""", cls AS (
  SELECT archive_path, is_wayback, page_id, size, mtime, CASE WHEN is_wayback THEN regexp_extract(p[4], '^\d+') END AS ts, CASE WHEN is_wayback THEN p[4] END AS ts_dir,
    CASE WHEN is_wayback THEN p[5] ELSE lower(p[2]) END AS host, '' AS port,
    array_to_string(CASE WHEN is_wayback THEN p[6:] ELSE p[3:] END, '/') AS url_path, CASE WHEN NOT is_wayback THEN p[1] END AS protocol
  FROM seg
), hosts AS (
  SELECT *, [host, CASE WHEN starts_with(host, 'www.') THEN host[5:] ELSE 'www.' || host END] AS hs, CASE WHEN is_wayback THEN ['http', 'https'] ELSE [protocol] END AS ps FROM cls
), idx AS (
  SELECT DISTINCT pr || '://' || h || '/' || url_path AS url_key, archive_path, ts, ts_dir, CAST(coalesce(rpad(ts, 14, '0'), '0') AS BIGINT) AS ts_num
  FROM (SELECT *, unnest(ps) AS pr FROM (SELECT *, unnest(hs) AS h FROM hosts))
)"""
)

_STATIC = "'https/web-static.archive.org/_static/js/' || page_id || '.js'"
TYPED = f"""
body AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'body {{ color: red }}' ELSE html END AS html FROM pages), typed0 AS (
  SELECT page_id, html, 'http/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://|/$', '', 'g') || {_list(ENDINGS)}[page_id % 8 + 1] AS archive_path FROM body
  UNION ALL SELECT page_id, html, {_STATIC} FROM body WHERE page_id % 10 = 0
), typed AS (
  SELECT *, CAST(strlen(html) AS BIGINT) AS size, lower(regexp_extract(archive_path, '[^/](\\.[^./]*)$', 1)) AS ext, regexp_extract(archive_path, '([^/]*)$', 1) AS base,
    TIMESTAMP '2023-11-14 22:13:20' + to_minutes(page_id) AS mtime FROM typed0
)""".replace("\\\\", "\\")

LINES = r"""
lines AS (
  SELECT page_id * 4 + k AS line_no, [' ' || url || chr(9), '# ' || url, CASE WHEN page_id % 7 = 0 THEN url || '/screenshot/x' ELSE url END, ''][k + 1] AS line
  FROM (SELECT *, unnest(range(0, 4)) AS k FROM pages)
), urls AS (
  SELECT min(line_no) AS line_no, url FROM (SELECT line_no, trim(line, ' ' || chr(9)) AS url FROM lines)
  WHERE url <> '' AND NOT starts_with(url, '#') AND NOT contains(url, '/screenshot/') GROUP BY url
)"""

# Storage paths of the tables' own URLs: an http or https scheme, no port, plain ASCII names.
DEST = rf"""
CASE WHEN ends_with(url, '/') THEN replace(regexp_replace(url, '/+$', ''), '://', '/') || '/{DIRECTORY_INDEX}'
  WHEN regexp_full_match(regexp_replace(url, '[?#].*$', ''), '[a-z]+://[^/]*/*') THEN replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '://', '/') || '/index.html'
  ELSE regexp_replace(replace(regexp_replace(url, '[?#].*$', ''), '://', '/'), '/+$', '') END"""

ABSOLUTE = r"""
absolute AS (
  SELECT [url, CASE WHEN starts_with(url, 'https:') THEN 'http:' || url[7:] ELSE 'https:' || url[6:] END, regexp_replace(url, '^([a-z]+)://(?:www\.)?', '\1://www.'), regexp_replace(url, '^[a-z]+:', '')][page_id % 4 + 1] AS url FROM pages
)"""
WAYBACK = r"""
wayback AS (
  SELECT '/web/' || CASE WHEN CAST(ts[14:14] AS INTEGER) % 2 = 0 THEN ts ELSE '2010' END || '/http://' || rest || '?q=1#top' AS url
  FROM (SELECT regexp_extract(archive_path, '/web/([^/]*)/', 1) AS ts, regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1) AS rest FROM captures WHERE starts_with(archive_path, 'https/web.archive.org/'))
)"""


def _probes(source: str, with_extensions: bool) -> str:
    """Keys to try for ``source``'s (url, lookup), with lookup an http or https URL without port."""
    more = "CASE WHEN NOT regexp_matches(path, '\\.[a-zA-Z0-9]{1,10}$') AND path <> '/' THEN [path || '.html', path || '.htm'] ELSE [] END" if with_extensions else "[]"
    return rf"""
parsed AS (
  SELECT *, regexp_extract(lookup, '^([a-z]+):', 1) AS proto, lower(regexp_extract(lookup, '^[a-z]+://([^/]*)', 1)) AS host,
    CASE WHEN regexp_extract(lookup, '^[a-z]+://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(lookup, '^[a-z]+://[^/]*(/.*)$', 1) END AS path FROM {source}
), pathed AS (
  SELECT *, list_concat([path, regexp_replace(path, '/$', '') || '/index.html'], CASE WHEN ends_with(path, '/') THEN list_transform({_list(DEFAULT_DOCS)}, lambda d: regexp_replace(path, '/$', '') || '/' || d) ELSE [] END, {more}) AS ps,
    CASE WHEN starts_with(host, 'www.') THEN host[5:] ELSE 'www.' || host END AS other_host, CASE WHEN proto = 'http' THEN 'https' ELSE 'http' END AS other_proto FROM parsed
), tried AS (
  SELECT * EXCLUDE (ps, path), unnest(ps) AS q, generate_subscripts(ps, 1) AS i FROM pathed
), probes AS (
  SELECT *, x.p || '://' || x.h || '/' || regexp_replace(q, '^/', '') AS url_key, x.n * 100 + i AS key_rank, x.p <> proto AS far
  FROM (SELECT *, unnest([{{'p': proto, 'h': host, 'n': 0}}, {{'p': proto, 'h': other_host, 'n': 1}}, {{'p': other_proto, 'h': host, 'n': 2}}, {{'p': other_proto, 'h': other_host, 'n': 3}}]) AS x FROM tried)
)"""


def _page(url: str) -> str:
    """SQL for where a URL without query would be stored, direct form."""
    named = rf"regexp_extract({url}, '^(?:[a-z]+:)?//[^/]*(/.*)?$', 1)"
    base = rf"CASE WHEN starts_with({url}, '//') THEN 'http/' ELSE regexp_extract({url}, '^([a-z]+):', 1) || '/' END || lower(regexp_extract({url}, '^(?:[a-z]+:)?//([^/]*)', 1))"
    return f"{base} || {_tail(named)}"


def _tail(path: str) -> str:
    return rf"CASE WHEN regexp_replace({path}, '/+', '/', 'g') IN ('', '/') THEN '/index.html' ELSE regexp_replace(regexp_replace({path}, '/+', '/', 'g'), '/$', '') || CASE WHEN ends_with({path}, '/') AND NOT regexp_matches({path}, '\.[a-zA-Z0-9]{{1,10}}/*$') THEN '/index.html' ELSE '' END END"


_SUFFIX = rf"""(ext IN {_in(NON_NATIVE_EXTENSIONS)} AND NOT regexp_matches(stem, '\.({"|".join(ASSET_ENDINGS)})$') AND stem NOT IN {_in(ASSET_NAMES)})"""
_IS_INDEX = f"(ext = '' AND lower(base) IN {_in(INDEX_NAMES)})"
_CELLS = ["""'<td align="center"><span class="' || CASE WHEN type = 'Wayback' THEN 'b-wb' ELSE 'b-dir' END || '">' || upper(type) || '</span></td>'""", """'<td class="sml">' || date_display || '</td>'""", """'<td class="dom">' || domain || '</td>'""",
  """'<td><a href="' || file_path || '" target="_blank">' || file_path || '</a></td>'""", """'<td class="sml" align="right">' || size || '</td>'"""]
_STRIPE = """'<tr class="' || CASE WHEN pos % 2 = 1 THEN 'row-norm' ELSE 'row-alt' END || '">'"""
_FLAT_ROWS = f"{_STRIPE} || {' || '.join(_CELLS)} || '</tr>'"
_HTML_ROWS = f"'    ' || {_STRIPE} || {' || '.join(f"chr(10) || '        ' || {c}" for c in _CELLS)} || chr(10) || '    </tr>'"
_CATALOGUE = (
    CAPTURES
    + r""", named AS (SELECT *, regexp_replace(archive_path, '/$|\.html$', '') || '.html' AS path FROM captures), listed AS (
  SELECT CASE WHEN k >= 0 THEN 'Wayback' ELSE 'Direct' END AS type, CASE WHEN k >= 0 THEN CAST(path[27:40] AS BIGINT) ELSE epoch_ms(mtime) END AS date_raw,
    CASE WHEN k >= 0 THEN regexp_replace(path[27:40], '(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)', '\1-\2-\3 \4:\5') ELSE strftime(mtime, '%Y-%m-%d %H:%M') END AS date_display,
    CASE WHEN k >= 0 THEN regexp_extract(path, '/web/[^/]*/([^/]*)', 1) ELSE regexp_extract(path, '^[^/]*') END AS domain, path AS file_path, CAST(CAST(ceil(size / 1024.0) AS BIGINT) AS VARCHAR) || 'KB' AS size
  FROM named WHERE size > 0 AND NOT contains(path, 'screenshot')
)"""
)


_OWN = r"""'<a href="http://' || regexp_replace(archive_path, '^https/web\.archive\.org/web/[^/]*/|^[a-z]+/', '') || '#top">own</a>'"""
_MARKED_PATH = r"regexp_replace(archive_path, '/$|\.html$', '') || '.html'"
MARKED = CAPTURES + f""", marked AS (SELECT page_id, k, html || {_quoted(INJECTED)} || {_OWN} AS text, {_MARKED_PATH} AS archive_path FROM captures)"""
# The same captures under the names of marked pages, and their index.
MARKED_CLASSIFIED = CLASSIFIED.replace("captures AS (", "plain AS (").replace("), seg AS (", f"), captures AS (SELECT * REPLACE ({_MARKED_PATH} AS archive_path), html || {_quoted(INJECTED)} || {_OWN} AS text FROM plain), seg AS (")
_BYTES = "CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS text_md5"


# What of INJECTED a server takes out, and what a flattener does, as it stands there.
_SERVER_CUTS = ("<!-- BEGIN WAYBACK TOOLBAR INSERT --><div>bar</div><!-- END WAYBACK TOOLBAR INSERT -->", '<script src="/js/athena.js"></script>', "<script>window.RufflePlayer={}</script>")
_FLAT_CUTS = (*_SERVER_CUTS, '<base href="http://x.com/">')


def _without(text: str, cuts) -> str:
    for cut in cuts:
        text = f"replace({text}, {_quoted(cut)}, '')"
    return text


def _cleaned_for_server(text: str) -> str:
    return f"regexp_replace(regexp_replace({_without(text, _SERVER_CUTS)}, 'https?://web-static\\.archive\\.org/_static/', '/_static/', 'gi'), '<!-- End Wayback Rewrite JS Include -->', '', 'gi')".replace("\\\\", "\\")


def _served(text: str, ts: str) -> str:
    """SQL for a page as a local server gives it out. A mark of its own, chr(1), keeps steps apart."""
    attr, hosts = "(href|src|action|background)=[\"'']", "|".join(INFRASTRUCTURE).replace(".", "\\.")
    steps = (
        (attr + "https?://(?:www\\.)?web\\.archive\\.org(/web/[^\\n\\r]*?)[\"'']", "'\\1=' || chr(1) || '\"\\2\"'", "gi"),
        (attr + f"(?-i:https?://)((?:{hosts})(?:/[^\\n\\r]*?)?)[\"'']", "'\\1=' || chr(1) || '\"/\\2\"'", "gi"),
        (attr + "((?-i:http)[^\\n\\r]*?)[\"'']", f"'\\1=' || chr(1) || '\"/web/' || {ts} || '/\\2\"'", "gi"),
        ("url\\([\"'']?https?://(?:www\\.)?web\\.archive\\.org(/web/[^\\n\\r]*?)[\"'']?\\)", "'url' || chr(1) || '(''\\1'')'", "gi"),
        ("url\\([\"'']?(http[^\\n\\r]*?)[\"'']?\\)", f"'url' || chr(1) || '(''/web/' || {ts} || '/\\1'')'", "gi"),
    )
    for pattern, by, how in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, '{how}')"
    return f"regexp_replace(replace({text}, chr(1), ''), '(?:https?:)?//(?:www\\.)?web\\.archive\\.org/web/(\\d{{{{4,14}}}})', '/web/\\1', 'gi')".replace("{{", "{").replace("}}", "}")


def _flattened(columns: str) -> str:
    """SQL for flattened pages, for the forms that marked pages have: links from the root lead to no capture, a page's
    link to itself leads to the nearest one, and all other links to where their target would be stored."""
    direct = "CASE WHEN url = 'http://x.com/' THEN 'http/x.com/index.html' WHEN url = 'http://archive.org/logo.png' THEN 'http/archive.org/logo.png' WHEN url = 'https://web.archive.org/web/20050101/http://x.com/b' THEN 'https/web.archive.org/web/20050101/x.com/b' END"
    direct = direct.replace(" END", f" WHEN ends_with(url, '#top') THEN {_page("regexp_replace(url, '[?#].*$', '')")} END")
    return rf"""WITH {MARKED_CLASSIFIED}, pages_in AS (
      SELECT archive_path, is_wayback, CASE WHEN is_wayback THEN {_without("text", _FLAT_CUTS)} ELSE text END AS text,
        list_filter(string_split(regexp_replace(archive_path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS dir, CASE WHEN is_wayback THEN 'https/web.archive.org/web/' || p[4] || '/' || p[5] END AS root FROM seg
    ), attrs AS (
      SELECT archive_path, m, regexp_extract(m, '^[a-zA-Z]+') AS attr, m[-1:] AS quote, regexp_extract(m, '=\s*["''](.*)["'']$', 1) AS url
      FROM (SELECT archive_path, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:href|src|action|background|data)\s*=\s*(?:"[^"\n\r]*"|''[^''\n\r]*'')'))) AS m FROM pages_in)
    ), src AS (SELECT DISTINCT url, regexp_replace(url, '[?#].*$', '') AS lookup FROM attrs WHERE ends_with(url, '#top')), {_probes("src", True)},
    best AS (SELECT url, arg_min(archive_path, (far, abs(ts_num - {TARGET}), key_rank, archive_path)) AS target FROM probes JOIN idx USING (url_key) GROUP BY url),
    asked AS (
      SELECT archive_path, m, url, attr || '=' || quote AS before, quote AS after FROM attrs UNION ALL
      SELECT archive_path, x.m, x.url, x.b, x.a FROM (SELECT archive_path, unnest([
        {{'m': 'url( ''/img/c.png'' )', 'url': '/img/c.png', 'b': 'url(', 'a': ')'}}, {{'m': '@import "/css/d.css";', 'url': '/css/d.css', 'b': '@import "', 'a': '";'}},
        {{'m': '//web.archive.org/web/2005im_/http://x.com/e.js', 'url': 'e.js', 'b': '', 'a': ''}}]) AS x FROM pages_in)
    ), placed AS (
      SELECT archive_path, dir, m, before, after, regexp_extract(url, '#.*$') AS hash,
        string_split(CASE WHEN url = 'e.js' THEN 'http/x.com/e.js' WHEN starts_with(url, '/') THEN root || regexp_replace(url, '[?#].*$', '') ELSE coalesce(target, {direct}) END, '/') AS target
      FROM asked JOIN pages_in USING (archive_path) LEFT JOIN best USING (url)
    ), shared AS (SELECT *, len(list_filter(range(1, least(len(dir), len(target)) + 1), lambda i: dir[1:i] = target[1:i])) AS c FROM placed WHERE target IS NOT NULL),
    rels AS (SELECT *, repeat('../', len(dir) - c) || array_to_string(target[c + 1:], '/') AS rel FROM shared),
    swaps AS (SELECT archive_path, list({{'m': m, 'n': before || CASE WHEN starts_with(rel, '.') THEN rel ELSE './' || rel END || hash || after}}) AS swaps FROM rels GROUP BY archive_path),
    swapped AS (
      SELECT archive_path, dir, list_reduce(list_concat([{{'m': text, 'n': ''}}], coalesce(swaps, [])), lambda a, x: {{'m': replace(a.m, x.m, x.n), 'n': ''}}).m AS text FROM pages_in LEFT JOIN swaps USING (archive_path)
    ), done AS (
      SELECT archive_path, replace(text, '''https://web-static.archive.org/_static/', '''' || CASE WHEN len(dir) = 0 THEN './https/' WHEN dir[1] = 'https' THEN repeat('../', len(dir) - 1) ELSE repeat('../', len(dir)) || 'https/' END || 'web-static.archive.org/_static/') AS t FROM swapped
    ) SELECT archive_path, {columns} FROM done"""


def _flag(name: str, expression: str) -> str:
    return f"WITH {TYPED} SELECT archive_path, {expression} AS {name} FROM typed"


_LISTING = f"""WITH {TYPED}, levels AS (
      SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS dir, p[i] AS name, i < len(p) AS is_dir, CASE WHEN i = len(p) THEN size END AS bytes
      FROM (SELECT string_split(archive_path, '/') AS p, size, unnest(range(1, len(string_split(archive_path, '/')) + 1)) AS i FROM typed)
    ), e AS (SELECT dir, name, is_dir, max(bytes) AS bytes FROM levels GROUP BY ALL)
    SELECT dir, name, is_dir, CASE WHEN is_dir THEN '-' ELSE CAST(floor(bytes * 10 / 1024.0 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(bytes * 10 / 1024.0 + 0.5) AS BIGINT) % 10 || ' KB' END AS size,
      row_number() OVER (PARTITION BY dir ORDER BY is_dir DESC, lower(name), name) AS pos FROM e"""


_HOSTED = f"""WITH h AS (
      SELECT page_id, {_list(n or "" for _, n in HOSTS)}[page_id % {len(HOSTS)} + 1] AS host, CASE WHEN page_id % 3 = 0 THEN '8080' ELSE '' END AS port FROM pages)"""
_BODY = "coalesce(t, CASE WHEN k < 2 THEN '404: Page not found locally.' ELSE '404 Not Found' END)"
_SENT = rf"""WITH {CLASSIFIED}, req AS (
        SELECT page_id * 5 + k AS request_id, k, [strftime(DATE '2005-01-01' + to_months(CAST(page_id % 12 AS INTEGER)), '%Y%m'), '20041231im_', NULL, NULL, NULL][k + 1] AS ts,
          CASE WHEN k < 2 THEN regexp_replace(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')), '/$', '') WHEN k = 3 THEN 'http/' || regexp_replace(lower(regexp_replace(regexp_replace(url, '\?.*$', ''), '^[a-z]+://', '')), '/$', '') END AS fold
        FROM (SELECT *, unnest(range(0, 5)) AS k FROM pages)
      ), files AS (SELECT archive_path, ts_dir, ts, unnest([lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), regexp_replace(lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), '/index\.html$', '')]) AS fold FROM cls WHERE is_wayback),
      direct AS (SELECT archive_path, unnest([lower(archive_path), regexp_replace(lower(archive_path), '/index\.html$', '')]) AS fold, unnest([0, 1]) AS variant FROM cls WHERE NOT is_wayback),
      near AS (SELECT request_id, arg_min({{'d': ts_dir, 'p': archive_path}}, (ts_dir <> req.ts, abs(CAST(rpad(files.ts, 14, '0') AS BIGINT) - CAST(rpad(regexp_extract(req.ts, '^\d+'), 14, '0') AS BIGINT)), ts_dir, archive_path)) AS b
        FROM req JOIN files ON req.fold = files.fold WHERE k < 2 GROUP BY request_id),
      tried AS (SELECT request_id, unnest([fold, regexp_replace(fold, '^http/', 'http/www.'), regexp_replace(fold, '^http/www\.', 'http/')]) AS fold FROM req WHERE k = 3),
      smart AS (SELECT request_id, arg_min(archive_path, (variant, archive_path)) AS p FROM tried JOIN direct USING (fold) GROUP BY request_id),
      found AS (SELECT req.request_id, k AS k, coalesce(b.p, p) AS archive_path, b.d AS ts_dir FROM req LEFT JOIN near USING (request_id) LEFT JOIN smart USING (request_id)),
      typed AS (SELECT found.* , html, lower(regexp_extract(found.archive_path, '[^/](\.[^./]*)$', 1)) AS ext FROM found LEFT JOIN captures USING (archive_path)),
      sent AS (SELECT *, CASE WHEN ts_dir IS NOT NULL AND (ext IN {_in(SERVED_AS_HTML)} OR ext IN ('.css', '.js')) THEN {_served(_cleaned_for_server("html"), "ts_dir")} ELSE html END AS t FROM typed)"""
_ANSWER = rf"""request_id, CASE WHEN archive_path IS NULL THEN 404 ELSE 200 END AS status, archive_path, md5({_BODY}) AS body_md5,
        CASE WHEN archive_path IS NULL THEN 'text/plain' ELSE CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_TYPES.items())} ELSE 'application/octet-stream' END ||
          CASE WHEN ext IN {_in(SERVED_AS_HTML)} THEN '; charset=' || coalesce(nullif(regexp_extract(t[1:8192], '(?i)<meta[^>]+charset\s*=\s*["'']?([a-zA-Z0-9\-_]+)', 1), ''), 'iso-8859-1') ELSE '' END END AS content_type"""

ORACLES = {
    "web_pages": _flag("web_pages", f"NOT contains(archive_path, 'screenshot') AND (ext IN {_in(HTML_EXTENSIONS)} OR {_IS_INDEX})"),
    "flat_web_pages": _flag("flat_web_pages", f"NOT contains(base, 'screenshot') AND (ext IN ('.html', '.htm') OR {_IS_INDEX})"),
    "text_files": _flag("text_files", f"ext IN {_in(TEXT_EXTENSIONS)} OR {_IS_INDEX}"),
    "html_files": _flag("html_files", f"ext IN {_in(HTML_EXTENSIONS)} OR {_IS_INDEX}"),
    "file_ext": _flag("file_ext", "ext"),
    "mime_types": _flag("mime_types", "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_TYPES.items()) + " ELSE 'application/octet-stream' END"),
    "scan_captures": f"WITH {CAPTURES} SELECT archive_path, size, is_wayback FROM seg WHERE len(list_filter(p, lambda s: starts_with(s, '.') OR s = 'node_modules')) = 0",
    "classify_captures": f"""WITH {CLASSIFIED} SELECT archive_path, is_wayback, ts, host, port, url_path,
      array_to_string(flatten(list_transform(ps, lambda x: list_transform(hs, lambda h: x || '://' || h || '/' || url_path))), ' ') AS url_keys FROM hosts""",
    "url_index": f"WITH {CLASSIFIED} SELECT url_key, archive_path, ts, ts_num FROM idx",
    "url_index_grouped": f"WITH {CLASSIFIED} SELECT url_key, CAST(0 AS BIGINT) AS page, count(*) AS n_entries, string_agg(archive_path, ' ' ORDER BY archive_path) AS paths FROM idx GROUP BY url_key",
    "archive_stats": f"""WITH {TYPED}, keyed AS (
      SELECT archive_path, unnest([h, CASE WHEN starts_with(h, 'www.') THEN h[5:] ELSE 'www.' || h END]) AS host, proto, rest FROM (
        SELECT archive_path, regexp_extract(archive_path, '^([^/]*)/', 1) AS proto, lower(regexp_extract(archive_path, '^[^/]*/([^/]*)', 1)) AS h, regexp_extract(archive_path, '^[^/]*/[^/]*/?(.*)$', 1) AS rest FROM typed))
      SELECT (SELECT count(*) FROM typed) AS files, CAST(0 AS BIGINT) AS wayback_files, (SELECT count(*) FROM typed) AS direct_files,
        (SELECT count(DISTINCT proto || '://' || host || '/' || rest) FROM keyed) AS unique_keys, (SELECT count(*) FROM (SELECT DISTINCT proto, host, rest, archive_path FROM keyed)) AS index_entries,
        (SELECT count(*) FROM typed WHERE ext IN {_in(NON_NATIVE_EXTENSIONS)} AND regexp_matches(html[1:4096], '(?i)<html')) AS sniffed_html,
        (SELECT count(*) FROM typed WHERE ext IN {_in(NON_NATIVE_EXTENSIONS)} AND NOT regexp_matches(html[1:4096], '(?i)<html')) AS sniffed_other""",
    "snapshot_dirs": f"WITH {CLASSIFIED} SELECT ts_dir, any_value(CAST(rpad(ts, 14, '0') AS BIGINT)) AS ts_num, count(*) AS n_files FROM cls WHERE is_wayback GROUP BY ts_dir",
    "sniff_html": f"WITH {TYPED} SELECT archive_path, regexp_matches(html[1:4096], '(?i)<html') AS is_html FROM typed WHERE ext IN {_in(NON_NATIVE_EXTENSIONS)}",
    "html_suffix": rf"WITH {TYPED} SELECT archive_path, {_SUFFIX} AS html_suffix FROM (SELECT *, lower(regexp_replace(base, '\.[^.]*$', '')) AS stem FROM typed)",
    "catalogue_scan": f"WITH {TYPED} SELECT archive_path, size FROM typed WHERE size > 0 AND NOT contains(archive_path, 'screenshot') AND (ext IN {_in(HTML_EXTENSIONS)} OR {_IS_INDEX})",
    "flat_catalogue_scan": f"WITH {TYPED} SELECT archive_path, size FROM typed WHERE size > 0 AND base <> 'index.html' AND NOT contains(base, 'screenshot') AND (ext IN ('.html', '.htm') OR {_IS_INDEX})",
    "catalogue": f"WITH {_CATALOGUE} SELECT row_number() OVER (ORDER BY domain, date_raw DESC, file_path) AS pos, * FROM listed",
    "catalogue_html": f"WITH {_CATALOGUE}, o AS (SELECT row_number() OVER (ORDER BY domain, date_raw DESC, file_path) AS pos, * FROM listed) SELECT pos, {_HTML_ROWS} AS html FROM o",
    "flat_catalogue_html": f"""WITH {TYPED}, o AS (
      SELECT 'Direct' AS type, strftime(mtime, '%Y-%m-%d %H:%M') AS date_display, regexp_extract(archive_path, '^[^/]*') AS domain, archive_path AS file_path, CAST(CAST(ceil(size / 1024.0) AS BIGINT) AS VARCHAR) || 'KB' AS size,
        row_number() OVER (ORDER BY regexp_extract(archive_path, '^[^/]*'), mtime DESC, archive_path) AS pos
      FROM typed WHERE size > 0 AND base <> 'index.html' AND NOT contains(base, 'screenshot') AND (ext IN ('.html', '.htm') OR {_IS_INDEX})) SELECT pos, {_FLAT_ROWS} AS html FROM o""",
    "directory_listing": _LISTING,
    "listing_pages": f"""WITH l AS ({_LISTING}), e AS (
      SELECT *, replace(replace(name, '&', '&amp;'), '''', '&#39;') AS shown, replace(replace(dir, '&', '&amp;'), '''', '&#39;') AS place FROM l
    ), r AS (
      SELECT dir, place, pos, '<tr><td class="type">' || CASE WHEN is_dir THEN '[DIR]' ELSE '[FILE]' END || '</td><td><a href="/' || CASE WHEN dir = '' THEN '' ELSE place || '/' END || shown || CASE WHEN is_dir THEN '/' ELSE '' END ||
        '">' || shown || '</a></td><td class="size">' || size || '</td></tr>' AS row FROM e
    ) SELECT dir, CAST(0 AS BIGINT) AS page, md5('<html><head><title>Index of /' || place || '</title></head><body><h2>Index of /' || place || '</h2><table><tr><th>Type</th><th>Name</th><th>Size</th></tr>' ||
      CASE WHEN dir <> '' THEN '<tr><td class="type">[DIR]</td><td><a href="/' || CASE WHEN contains(place, '/') THEN regexp_replace(place, '/[^/]*$', '') ELSE '' END || '">[ Parent Directory ]</a></td><td class="size">-</td></tr>' ELSE '' END ||
      string_agg(row, '' ORDER BY pos) || '</table></body></html>') AS html_md5 FROM r GROUP BY dir, place""",
    "url_list_load": f"WITH {LINES} SELECT line_no, url FROM urls",
    "pending_urls": f"""WITH {LINES} SELECT line_no, url, {DEST} AS dest FROM urls WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 9 = 1)
      AND {DEST} NOT IN (SELECT {DEST} FROM pages WHERE page_id % 8 = 0) AND {DEST} || '/index.html' NOT IN (SELECT {DEST} FROM pages WHERE page_id % 8 = 0)""",
    "fetch_plan": f"WITH {LINES}, {CAPTURES} SELECT line_no, url, {DEST} AS dest FROM urls WHERE {DEST} NOT IN (SELECT archive_path FROM captures) AND {DEST} || '/index.html' NOT IN (SELECT archive_path FROM captures)",
    "path_collisions": f"WITH {LINES} SELECT dest, count(*) AS n_urls, arg_min(url, line_no) AS first_url FROM (SELECT *, {DEST} AS dest FROM urls) GROUP BY dest HAVING count(*) > 1",
    "orphan_captures": f"SELECT page_id, dest FROM (SELECT page_id, {DEST} AS dest FROM pages) WHERE ends_with(dest, '{DIRECTORY_INDEX}')",
    "storage_paths": f"SELECT page_id, {DEST} AS dest FROM pages",
    "parse_urls": r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS hostname, '' AS port,
      CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS pathname,
      regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS search, regexp_extract(url, '(#.*)$', 1) AS hash FROM pages""",
    "parse_hosts": f"""{_HOSTED} SELECT page_id, nullif(host, '') AS hostname, CASE WHEN host <> '' THEN port END AS port,
      CASE WHEN host <> '' THEN '/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/%FF.html' ELSE '/%C3%A9.html' END END AS pathname FROM h""",
    "storage_hosts": f"""{_HOSTED} SELECT page_id, CASE WHEN host <> '' THEN 'http/' || replace(host, ':', '_') || CASE WHEN port <> '' THEN '/' || port ELSE '' END || '/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/%FF.html' ELSE '/é.html' END END AS dest FROM h""",
    "sanitize_segments": r"""WITH s AS (SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS a, repeat('x', 190) || regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS b FROM pages)
      SELECT page_id, CASE WHEN length(a) > 200 THEN a[1:150] || '_' || md5(a)[1:8] || regexp_extract(a, '[^/](\.[^./]*)$', 1) ELSE a END AS short_name,
        CASE WHEN length(b) > 200 THEN b[1:150] || '_' || md5(b)[1:8] || regexp_extract(b, '[^/](\.[^./]*)$', 1) ELSE b END AS long_name FROM s""",
    "escape_html": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages""",
    "strip_query": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(url, '#.*$') AS fragment FROM pages",
    "target_ts": "SELECT page_id, CAST([20010101000000, 20010301000000, 20010309000000, 19991231000000, 20200202000000][page_id % 5 + 1] AS BIGINT) AS target_ts FROM pages",
    "ts_normalize": rf"WITH {CLASSIFIED} SELECT archive_path, CAST(rpad(ts, 14, '0') AS BIGINT) AS full_ts, CAST(rpad(ts[1:6], 14, '0') AS BIGINT) AS month_ts FROM cls WHERE is_wayback",
    "page_context": rf"WITH {CLASSIFIED} SELECT archive_path, ts, CASE WHEN is_wayback THEN ts_dir[15:] END AS flags, CASE WHEN is_wayback THEN host END AS host FROM cls",
    "path_inside": "SELECT page_id, page_id % 3 <> 0 AS inside FROM pages",
    "infer_ext": r"""SELECT page_id, base || CASE WHEN regexp_extract(base, '[^/](\.[^./]*)$', 1) = '' THEN ['/index.html', '.jpg', '.png', '.js', '.css', '.gif', ''][page_id % 7 + 1] ELSE '' END AS dest
      FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base FROM pages)""",
    "redirect_targets": r"""SELECT page_id, [o || '/login?x=1', o || CASE WHEN f = '' THEN '/' ELSE f END || '/next.html', 'http://other.example/a', s || '//cdn.example/b'][page_id % 4 + 1] AS to_url
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS o, regexp_extract(url, '^[a-z]+:') AS s, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^$', '/'), '/[^/]*/?$', '') AS f FROM pages)""",
    "detect_charset": r'''SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'windows-1252' ELSE nullif(regexp_extract(html[1:8192], '(?i)<meta[^>]+charset\s*=\s*["'']?([a-zA-Z0-9\-_]+)', 1), '') END AS charset FROM pages''',
    "extract_links": r"""SELECT page_id, l[2:-2] AS url, count(*) AS n FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:href|src|action|background|data)\s*=\s*("[^"\n\r]*"|''[^''\n\r]*'')', 1)) AS l FROM pages) GROUP BY ALL""",
    "link_kinds": r"""WITH l AS (
      SELECT unnest(list_concat([url, '/web/2001/' || url, '#top', 'mailto:a@b'], list_transform(regexp_extract_all(html, '(?i)(?:href|src|action|background|data)\s*=\s*("[^"\n\r]*"|''[^''\n\r]*'')', 1), lambda x: x[2:-2]))) AS url FROM pages)
      SELECT url, CASE WHEN starts_with(url, '#') OR regexp_matches(url, '(?i)^(javascript|data|mailto|blob):') THEN 'skip' WHEN NOT regexp_matches(url, '(?i)^(https?:|ftp:|//|/)') THEN 'relative'
        WHEN regexp_matches(url, '(?i)^/web/\d{4,14}') THEN 'wayback' WHEN starts_with(url, '/') AND NOT starts_with(url, '//') THEN 'root' ELSE 'absolute' END AS kind, count(*) AS n FROM l GROUP BY ALL""",
    "fallback_paths": rf"""WITH {CAPTURES}, {ABSOLUTE}, {WAYBACK}, u AS (SELECT DISTINCT url, regexp_replace(url, '[?#].*$', '') AS b FROM (SELECT url FROM absolute UNION ALL SELECT url FROM wayback))
      SELECT url, CASE WHEN starts_with(b, '/web/') THEN 'https/web.archive.org/web/' || regexp_extract(b, '^/web/([^/]*)/', 1) || '/' || lower(regexp_extract(b, '^/web/[^/]*/http://([^/]*)', 1)) || {_tail("regexp_extract(b, '^/web/[^/]*/http://[^/]*(.*)$', 1)")}
        ELSE {_page("b")} END AS target_path FROM u""",
    "relative_paths": r"""WITH """
    + CAPTURES
    + r""", t AS (SELECT archive_path, list_filter(string_split(regexp_replace(archive_path, '/[^/]*$', ''), '/'), lambda s: s <> '') AS a, list_filter(string_split('https/web.archive.org/web/' || regexp_extract(archive_path, '/web/([^/]*)/', 1) || '/other/a.gif', '/'), lambda s: s <> '') AS b FROM captures),
      n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS c FROM t), r AS (SELECT archive_path, repeat('../', len(a) - c) || array_to_string(b[c + 1:], '/') AS rel FROM n)
      SELECT archive_path, CASE WHEN starts_with(rel, '.') THEN rel ELSE './' || rel END AS rel FROM r""",
    "resolve_links": rf"""WITH {CLASSIFIED}, {ABSOLUTE}, src AS (SELECT DISTINCT url, regexp_replace(url, '[?#].*$', '') AS b, CASE WHEN starts_with(url, '//') THEN 'http:' ELSE '' END || regexp_replace(url, '[?#].*$', '') AS lookup FROM absolute), {_probes("src", True)},
      best AS (SELECT url, arg_min(archive_path, (far, abs(ts_num - {TARGET}), key_rank, archive_path)) AS target FROM probes JOIN idx USING (url_key) GROUP BY url)
      SELECT url, coalesce(target, {_page("b")}) AS target_path, CASE WHEN target IS NULL THEN 'fallback' ELSE 'index' END AS how FROM src LEFT JOIN best USING (url)""",
    "resolve_links_ts": rf"""WITH {CLASSIFIED}, {WAYBACK}, src AS (SELECT DISTINCT url, regexp_extract(url, '^/web/([^/]*)/', 1) AS dir, regexp_replace(regexp_extract(url, '^/web/[^/]*/(.*)$', 1), '[?#].*$', '') AS lookup FROM wayback), {_probes("src", False)},
      best AS (SELECT url, arg_min(archive_path, (NOT contains(archive_path, '/' || dir || '/'), far, abs(ts_num - {TARGET}), key_rank, archive_path)) AS target FROM probes JOIN idx USING (url_key) GROUP BY url)
      SELECT url, target AS target_path, 'index' AS how FROM best""",
    "resolve_root_relative": rf"""WITH {CLASSIFIED}, asked AS (
        SELECT DISTINCT ts_dir, host, unnest(['/' || url_path, '/missing/a.asp?x=1#y']) AS url FROM cls WHERE is_wayback
      ), src AS (SELECT ts_dir AS dir, host AS h, url, s || host || regexp_replace(url, '[?#].*$', '') AS lookup, n AS attempt FROM (SELECT *, unnest(['http://', 'https://']) AS s, unnest([0, 1]) AS n FROM asked)), {_probes("src", False)},
      best AS (SELECT dir, h, url, arg_min(archive_path, (attempt, NOT contains(archive_path, '/' || dir || '/'), far, abs(ts_num - {TARGET}), key_rank, archive_path)) AS target FROM probes JOIN idx USING (url_key) GROUP BY 1, 2, 3)
      SELECT ts_dir, host, asked.url, coalesce(target, 'https/web.archive.org/web/' || ts_dir || '/' || host || '/missing/a.asp') AS target_path, CASE WHEN target IS NULL THEN 'fallback' ELSE 'index' END AS how
      FROM asked LEFT JOIN best ON best.dir = ts_dir AND best.h = host AND best.url = asked.url""",
    "nearest_snapshot": rf"""WITH {CLASSIFIED}, req AS (
        SELECT page_id * 3 + k AS request_id, strftime(TIMESTAMP '2003-01-01' + to_days(CAST(page_id * 53 % 7000 + k * 777 AS INTEGER)), '%Y%m') || CASE WHEN k = 2 THEN 'id_' ELSE '' END AS ts,
          regexp_replace(regexp_replace(CASE WHEN k = 1 THEN upper(rest) ELSE rest END, '(?i)^https?://', ''), '/$', '') AS fold
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS rest, unnest(range(0, 3)) AS k FROM pages)
      ), files AS (SELECT archive_path, ts_dir, ts, unnest([lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), regexp_replace(lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), '/index\.html$', '')]) AS fold FROM cls WHERE is_wayback),
      best AS (SELECT request_id, arg_min({{'d': ts_dir, 'p': archive_path, 'e': ts_dir = req.ts}}, (ts_dir <> req.ts, abs(CAST(rpad(files.ts, 14, '0') AS BIGINT) - CAST(rpad(req.ts[1:6], 14, '0') AS BIGINT)), ts_dir, archive_path)) AS b
        FROM req JOIN files ON lower(req.fold) = files.fold GROUP BY request_id)
      SELECT request_id, b.d AS ts_dir, b.p AS archive_path, CASE WHEN b.e THEN 'exact' WHEN b.d IS NOT NULL THEN 'nearest' END AS how FROM req LEFT JOIN best USING (request_id)""",
    "nearest_chronological": rf"""WITH {CLASSIFIED}, req AS (
        SELECT page_id * 3 + k AS request_id, strftime(TIMESTAMP '2003-01-01' + to_days(CAST(page_id * 53 % 7000 + k * 777 AS INTEGER)), '%Y%m') || CASE WHEN k = 2 THEN 'id_' ELSE '' END AS ts,
          regexp_replace(regexp_replace(CASE WHEN k = 1 THEN upper(rest) ELSE rest END, '(?i)^https?://', ''), '/$', '') AS fold
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS rest, unnest(range(0, 3)) AS k FROM pages)
      ), files AS (SELECT archive_path, ts_dir, ts, unnest([lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), regexp_replace(lower(regexp_extract(archive_path, '/web/[^/]*/(.*)$', 1)), '/index\.html$', '')]) AS fold FROM cls WHERE is_wayback),
      best AS (SELECT request_id, arg_min({{'d': ts_dir, 'p': archive_path, 'e': ts_dir = req.ts}}, (ts_dir <> req.ts, abs(epoch(strptime(files.ts, '%Y%m%d%H%M%S')) - epoch(strptime(req.ts[1:6] || '01', '%Y%m%d'))), ts_dir, archive_path)) AS b
        FROM req JOIN files ON lower(req.fold) = files.fold GROUP BY request_id)
      SELECT request_id, b.d AS ts_dir, b.p AS archive_path, CASE WHEN b.e THEN 'exact' WHEN b.d IS NOT NULL THEN 'nearest' END AS how FROM req LEFT JOIN best USING (request_id)""",
    "name_mapping": r"""SELECT short, arg_min(original, page_id) AS original FROM (SELECT page_id, o AS original, o[1:150] || '_' || md5(o)[1:8] || '.html' AS short FROM (SELECT page_id, repeat('n', 195) || ' ' || page_id || '_tail.html' AS o FROM pages)) GROUP BY short""",
    "state_load": "SELECT unnest([url, url || '#2']) AS url FROM pages WHERE page_id % 6 <> 0",
    "smart_find": r"""WITH files AS (
        SELECT DISTINCT CASE WHEN length(a) % 2 = 0 THEN a || '/index.html' ELSE a END AS archive_path FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$|/$', ''), '://', '/') AS a FROM pages)
      ), folded AS (SELECT archive_path, unnest([lower(archive_path), regexp_replace(lower(archive_path), '/index\.html$', '')]) AS fold, unnest([0, 1]) AS variant FROM files),
      req AS (SELECT page_id AS request_id, lower(regexp_replace(regexp_replace([url, upper(url), regexp_replace(url, '^[a-z]+://(?:www\.)?', 'http/www.'), regexp_replace(url, '^[a-z]+://', '')][page_id % 4 + 1], '[?#].*$', ''), '^(https?)://', '\1/')) AS f FROM pages),
      tidy AS (SELECT request_id, array_to_string(list_filter(string_split(f, '/'), lambda s: s <> ''), '/') AS f FROM req),
      rooted AS (SELECT request_id, f, 0 AS attempt FROM tidy UNION ALL SELECT request_id, 'http/' || f, 1 FROM tidy WHERE NOT starts_with(f, 'http')),
      probes AS (SELECT DISTINCT request_id, attempt, unnest(CASE WHEN regexp_matches(f, '^https?/') THEN [f, regexp_replace(f, '^(https?)/', '\1/www.'), regexp_replace(f, '^(https?)/www\.', '\1/')] ELSE [f] END) AS fold FROM rooted)
      SELECT tidy.request_id, arg_min(archive_path, (attempt, variant, archive_path)) AS archive_path FROM tidy LEFT JOIN (SELECT * FROM probes JOIN folded USING (fold)) h ON h.request_id = tidy.request_id GROUP BY 1""",
    "parse_requests": r"""WITH q AS (SELECT page_id * 5 + k AS request_id, k, page_id, url, regexp_replace(url, '^[a-z]+://', '') AS bare FROM (SELECT *, unnest(range(0, 5)) AS k FROM pages)), r AS (
        SELECT *, ['/web/2005' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '/' || url, '/https/web.archive.org/web/20041231im_/' || bare, '/_static/js/' || page_id || '.js?v=1', 'http://localhost:8080/http/' || bare, CASE WHEN page_id = 0 THEN '/index.html' ELSE '/missing/' || page_id END][k + 1] AS path FROM q)
      SELECT request_id, path, ['wayback', 'wayback', 'static', 'file', CASE WHEN page_id = 0 THEN 'root' ELSE 'file' END][k + 1] AS route, [path[6:11], '20041231im_', NULL, NULL, NULL][k + 1] AS ts,
        [regexp_replace(url, '[?#].*$', ''), regexp_replace(bare, '[?#].*$', ''), '_static/js/' || page_id || '.js', 'http/' || regexp_replace(bare, '\?.*$', ''), CASE WHEN page_id = 0 THEN 'index.html' ELSE 'missing/' || page_id END][k + 1] AS url FROM r""",
    "static_lookup": "SELECT page_id * 5 + 2 AS request_id, CASE WHEN page_id % 10 = 0 THEN 'https/web-static.archive.org/_static/js/' || page_id || '.js' END AS archive_path FROM pages",
    "rewrite_flat": _flattened(_BYTES),
    "flatten_outputs": _flattened("archive_path AS output_path, 'rewritten' AS action, md5(t) AS content_md5"),
    "flatten_mixed": rf"""WITH {CAPTURES}, m AS (
      SELECT length(archive_path) % 4 AS kind, regexp_replace(archive_path, '/$', '') || ['.css', '.js', '.gif', '.php'][length(archive_path) % 4 + 1] AS archive_path FROM captures WHERE k >= 0
    ), d AS (SELECT *, len(string_split(archive_path, '/')) - 1 AS depth FROM m),
    r AS (SELECT *, CASE WHEN depth = 5 THEN './' ELSE repeat('../', depth - 5) END AS root, repeat('../', depth - 3) AS web FROM d)
    SELECT archive_path, archive_path || CASE WHEN kind = 3 THEN '.html' ELSE '' END AS output_path, CASE WHEN kind = 2 THEN 'copied' ELSE 'rewritten' END AS action, false AS failed,
      md5(['body{{background:url(' || root || 'img/a.png)}}' || chr(10) || '@import "' || root || 'css/b.css";', 'var u="' || web || '2001im_/y.com/z.js";', 'GIF89a url(/x)', '<html><a href="x.htm">'][kind + 1]) AS content_md5 FROM r""",
    "tree_files": "SELECT 'd' || page_id % 7 || '/' || page_id || '.html' AS archive_path, CAST(strlen(html) AS BIGINT) AS size FROM pages WHERE page_id % 13 <> 0 AND strlen(html) > 0",
    "save_locations": "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN CASE WHEN page_id % 2 = 0 THEN '/home/docs/' ELSE '/data/' END || page_id END AS location FROM pages",
    "fetch_results": rf"""WITH {LINES}, placed AS (SELECT url, line_no, {DEST} AS dest, length(regexp_replace(url, '[?#].*$', '')) % 3 AS kind FROM urls),
      tried AS (SELECT *, coalesce(min(CASE WHEN kind <> 0 THEN line_no END) OVER (PARTITION BY regexp_replace(dest, '/index\.html$', '')), line_no) >= line_no AS asked FROM placed)
      SELECT url, dest || CASE WHEN kind = 1 AND regexp_extract(dest, '[^/](\.[^./]*)$', 1) = '' THEN '.css' ELSE '' END AS dest, CAST(CASE WHEN kind = 0 THEN 404 ELSE 200 END AS INTEGER) AS status, CASE WHEN kind = 0 THEN 'HTTP 404' END AS error,
        CASE kind WHEN 1 THEN md5(regexp_extract(url, '^[a-z]+://[^/]*') || '/moved') WHEN 2 THEN md5(url) END AS content_md5 FROM tried WHERE asked""",
    "ingest_record": rf"""WITH urls AS (SELECT DISTINCT trim(url) AS url FROM pages WHERE NOT contains(url, '/screenshot/')), placed AS (SELECT url, {DEST} AS dest FROM urls)
      SELECT url FROM placed WHERE length(regexp_replace(url, '[?#].*$', '')) % 3 <> 0""",
    "clean_marks": f"""WITH m AS (SELECT page_id, html, [{", ".join(_quoted(m) for m, _, _ in MARKS)}][page_id % {len(MARKS)} + 1] AS piece, {[f for _, f, _ in MARKS]}[page_id % {len(MARKS)} + 1] AS flat, {[f for _, _, f in MARKS]}[page_id % {len(MARKS)} + 1] AS server FROM pages)
      SELECT page_id, md5('<p>' || page_id || CASE WHEN flat THEN '' ELSE piece END || '</p>' || html) AS flat_md5, md5('<p>' || page_id || CASE WHEN server THEN '' ELSE piece END || '</p>' || html) AS server_md5 FROM m""",
    "clean_flat": f"WITH {MARKED} SELECT archive_path, {_BYTES} FROM (SELECT archive_path, {_without('text', _FLAT_CUTS)} AS t FROM marked)",
    "clean_server": rf"""WITH {MARKED} SELECT archive_path, {_BYTES} FROM (
      SELECT archive_path, regexp_replace(regexp_replace({_cleaned_for_server("text")}, '__wm\.init\(["''][^"'']*["'']\)', '__wm.init("http://localhost:8080/web")', 'g'), '"https?://web\.archive\.org/"', '"http://localhost:8080/"', 'g') AS t FROM marked)""",
    "rewrite_server": f"WITH {MARKED} SELECT archive_path, {_BYTES} FROM (SELECT archive_path, {_served(_cleaned_for_server('text'), repr('20050101'))} AS t FROM marked)",
    "extract_css_urls": rf"""WITH {MARKED} SELECT archive_path, unnest(list_concat(regexp_extract_all(text, '(?i)url\(\s*["'']?([^\n\r]*?)["'']?\s*\)', 1),
      list_transform(regexp_extract_all(text, '(?i)@import\s+(?:url\(\s*)?["'']?([^\n\r]+?)["'']?\s*\)?\s*;', 1), lambda u: trim(regexp_replace(u, '["'']', '', 'g'))))) AS url FROM marked""",
    "serve_requests": f"{_SENT} SELECT {_ANSWER} FROM sent",
    "serve_indexed": f"{_SENT} SELECT {_ANSWER}, CAST(strlen({_BODY}) AS BIGINT) AS content_length FROM sent",
    "serve_pieces": f"{_SENT}, b AS (SELECT request_id, CAST(strlen({_BODY}) AS BIGINT) AS n FROM sent), o AS (SELECT *, unnest(range(0, n, 1000)) AS \"offset\" FROM b) SELECT request_id, \"offset\", least(1000, n - \"offset\") AS n_bytes FROM o",
    "serve_plan": f"""WITH {TYPED} SELECT archive_path, CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_TYPES.items())} ELSE 'application/octet-stream' END AS mime,
      ext IN {_in(SERVED_AS_HTML)} OR ext IN ('.css', '.js') AS buffered_archived, ext IN {_in(SERVED_AS_HTML)} AS buffered_plain FROM typed""",
}
