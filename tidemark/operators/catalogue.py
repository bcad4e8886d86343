"""Catalogues and listings of captures, and their HTML reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import catalogue_size, escape_html, is_flat_web_page, is_web_page, listing_size
from ..sources.captures import IGNORED, visible
from .lookup import entries
from .ranking import ranked

#: Entries on one page of a folder's listing.
LISTED = 10_000


def pages(captures: DataFrame) -> DataFrame:
    """The captures that an archive's catalogue lists: non-empty web pages."""
    return visible(captures, IGNORED).filter((F.col("size") > 0) & is_web_page(F.col("archive_path")))


def flat_pages(captures: DataFrame) -> DataFrame:
    """The files that a flattened tree's catalogue lists; index.html never is one, nor a further page of the report."""
    return visible(captures, ("index.html",)).filter((F.col("size") > 0) & is_flat_web_page(F.col("archive_path")) & ~F.col("archive_path").rlike(r"^index-\d+\.html$"))


def describe(files: DataFrame, flat: bool = False) -> DataFrame:
    """(type, date_raw, date_display, domain, file_path, size) of pages.

    A page under a 14-digit timestamp is of type Wayback, with its host as the domain; any other is
    Direct, with the first path segment as the domain and the file's time as its date.
    """
    pattern = r"(?i)web\.archive\.org/web/(\d{14})[a-z0-9_]*/([^/]+)" if flat else r"web\.archive\.org/web/(\d{14})[a-z0-9_]*/([^/]*)"
    wayback = F.col("archive_path").rlike(pattern)
    ts, host = F.regexp_extract("archive_path", pattern, 1), F.regexp_extract("archive_path", pattern, 2)
    shown = F.regexp_replace(ts, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5")
    return files.select(
        F.when(wayback, "Wayback").otherwise("Direct").alias("type"),
        F.when(wayback, F.nullif(ts, F.lit("")).cast("long")).otherwise(F.unix_millis("mtime")).alias("date_raw"),
        F.when(wayback, shown).otherwise(F.date_format("mtime", "yyyy-MM-dd HH:mm")).alias("date_display"),
        F.when(wayback, F.when(host != "", host).otherwise("archive.org")).otherwise(F.substring_index("archive_path", "/", 1)).alias("domain"),
        F.col("archive_path").alias("file_path"),
        catalogue_size(F.col("size")).alias("size"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Catalogue rows by domain, newest first; ``pos`` is the place in that order of the whole."""
    return ranked(rows, [], [F.col("domain"), F.desc("date_raw"), F.col("file_path")]).select("pos", *rows.columns)


# The cells of a report's row, in one line or with a line each, and the head of its table.
_CELLS = ('<td align="center"><span class="{badge}">{type}</span></td>', '<td class="sml">{date}</td>', '<td class="dom">{domain}</td>', '<td><a href="{path}" target="_blank">{path}</a></td>', '<td class="sml" align="right">{size}</td>')
_HEAD = ('<th width="80">Type</th>', '<th width="140">Date</th>', '<th width="180">Domain</th>', "<th>Path</th>", '<th width="60">Size</th>')
TITLES = {False: "Local Web Mirror Index", True: "Local Web Archive"}
HEADINGS = {False: "Local Web Archive Index ({n} Pages)", True: "Local Web Archive ({n} Pages)"}
FOOTERS = {False: "Best viewed in Internet Explorer 6", True: "Standalone archive"}

_STYLE = "body{font:11px Verdana,sans-serif;margin:15px}table{width:100%;border-collapse:collapse}th,td{border:1px solid #999;padding:3px 5px;text-align:left}.row-alt{background:#f7f7f7}.b-wb,.b-dir{color:#fff;font-weight:bold;padding:1px 3px}.b-wb{background:#c60}.b-dir{background:#06c}.dom{font-weight:bold}.sml{color:#666;font-size:10px}.footer{color:#999;font-size:10px;text-align:center}"


def html_rows(catalogue: DataFrame, flat: bool = False) -> DataFrame:
    """(pos, html): the report's table rows, striped by place; a flattened tree's have one line each."""
    values = {
        "badge": F.when(F.col("type") == "Wayback", "b-wb").otherwise("b-dir"), "type": escape_html(F.upper("type")), "date": escape_html(F.col("date_display")),
        "domain": escape_html(F.col("domain")), "path": escape_html(F.col("file_path")), "size": escape_html(F.col("size")),
    }
    template = '<tr class="{stripe}">' + "".join(_CELLS) + "</tr>" if flat else '    <tr class="{stripe}">\n        ' + "\n        ".join(_CELLS) + "\n    </tr>"
    values["stripe"] = F.when(F.col("pos") % 2 == 1, "row-norm").otherwise("row-alt")
    parts = re.split(r"\{(\w+)\}", template)
    return catalogue.select("pos", F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)]).alias("html"))


def report(catalogue: DataFrame, generated: str, flat: bool = False) -> DataFrame:
    """(path, content): the report's pages, index.html and from LISTED rows on index-2.html and so forth, each with a link to the next.

    ``generated`` is the time that the foot names.
    """
    total = catalogue.agg(F.count("*").alias("total"))
    paged = html_rows(catalogue, flat).withColumn("page", F.expr(f"(pos - 1) div {LISTED}")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "html"))).alias("rows"))
    # An empty catalogue has a page too; the counts are a table of one row.
    pages = F.broadcast(total).join(paged, F.lit(True), "left").withColumn("page", F.coalesce("page", F.lit(0)))
    heading = F.concat(*[F.col("total").cast("string") if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(n)\}", HEADINGS[flat]))])
    head = f'<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">\n<html>\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset=utf-8">\n<title>{TITLES[flat]}</title>\n<style type="text/css">{_STYLE}</style>\n</head>\n<body>\n<h1>'
    table = '</h1>\n<table cellpadding="0" cellspacing="0">\n<tr>' + "".join(_HEAD) + "</tr>\n"
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: r["html"]), "\n"), F.lit(""))
    more = F.when((F.col("page") + 1) * LISTED < F.col("total"), F.concat(F.lit('<p><a href="index-'), (F.col("page") + 2).cast("string"), F.lit('.html">more</a></p>\n'))).otherwise("")
    foot = F.concat(F.lit("\n</table>\n"), more, F.lit(f'<div class="footer">Generated on {generated} &bull; {FOOTERS[flat]}</div>\n</body>\n</html>'))
    name = F.when(F.col("page") == 0, "index.html").otherwise(F.concat(F.lit("index-"), (F.col("page") + 1).cast("string"), F.lit(".html")))
    return pages.select(name.alias("path"), F.encode(F.concat(F.lit(head), heading, F.lit(table), rows, foot), "UTF-8").alias("content"))


def listing(captures: DataFrame) -> DataFrame:
    """(dir, name, is_dir, size, pos) of every folder's entries: folders first, then by name without regard to case.

    ``dir`` is empty for the root.
    """
    return placed(entries(captures))


def placed(listed: DataFrame) -> DataFrame:
    """As ``listing``, of folder entries (dir, name, is_dir, bytes)."""
    order = ranked(listed, ["dir"], [F.desc("is_dir"), F.collate("name", "UNICODE"), F.col("name")])
    return order.select("dir", "name", "is_dir", F.when(F.col("is_dir"), "-").otherwise(listing_size(F.col("bytes"))).alias("size"), F.col("pos").cast("long").alias("pos"))


def listing_html(entries: DataFrame, whole: bool = False) -> DataFrame:
    """(dir, page, html): listing pages of every folder, from the rows of ``listing``.

    A page has at most LISTED entries, so that a folder of any size has pages of bounded size; a full
    one ends with a link to the next. Where a ``whole`` folder is asked for it has one page, 0, of all its entries.
    All but the root's first begin with a row for the folder above.
    """
    here = F.concat(F.lit("/"), F.col("dir"))
    inside = F.when(F.col("dir") == "", "/").otherwise(F.concat(here, F.lit("/")))
    cells = lambda kind, href, name, size: F.concat(F.lit(f'<tr><td class="type">{kind}</td><td><a href="'), href, F.lit('">'), name, F.lit('</a></td><td class="size">'), size, F.lit("</td></tr>"))
    href = F.concat(escape_html(F.concat(inside, "name")), F.when(F.col("is_dir"), "/").otherwise(""))
    row = F.when(F.col("is_dir"), cells("[DIR]", href, escape_html(F.col("name")), F.col("size"))).otherwise(cells("[FILE]", href, escape_html(F.col("name")), F.col("size")))
    page = F.lit(0).cast("long") if whole else F.expr(f"(pos - 1) div {LISTED}")
    rows = entries.select("dir", page.alias("page"), F.struct("pos", row.alias("row")).alias("r"))
    pages = rows.groupBy("dir", "page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    above = F.when(F.col("dir").contains("/"), F.concat(F.lit("/"), F.regexp_replace("dir", "/[^/]*$", ""))).otherwise("/")
    up = F.when((F.col("dir") != "") & (F.col("page") == 0), cells("[DIR]", escape_html(above), F.lit("[ Parent Directory ]"), F.lit("-"))).otherwise("")
    more = F.when(F.lit(not whole) & (F.size("rows") == LISTED), F.concat(F.lit('<p><a href="?page='), (F.col("page") + 1).cast("string"), F.lit('">more</a></p>'))).otherwise("")
    title = F.concat(F.lit("Index of "), escape_html(here))
    table = F.concat(F.lit("<table><tr><th>Type</th><th>Name</th><th>Size</th></tr>"), up, F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("</table>"))
    return pages.select("dir", "page", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><h2>"), title, F.lit("</h2>"), table, more, F.lit("</body></html>")).alias("html"))
