"""Site-relative line dedup: lines on more than a share of a host's pages are boilerplate; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, written

#: A line is boilerplate on a host if it is on over RATIO of its pages, and on MIN_PAGES pages at least: on the only page of a host every
#: line is on all pages, which tells nothing about it.
RATIO, MIN_PAGES = 0.3, 2
#: How markup becomes lines; replacements in this order.
MARKUP = (
    (r"(?is)<(script|style)\b.*?</(script|style)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|aside|main|title|head|body|html|meta|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
)
#: What the first patterns begin with; all that stands between is dropped.
OPENINGS = (r"<(?:script|style)\b", "<!--")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str = "url") -> Column:
    """The lower-case host; empty for a null url or one without."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def _once(pattern: str, opening: str) -> tuple[str, str]:
    """The pattern and its replacement for text that goes, so that an opening without a close is looked for once only: from there on the text is put back as it is.

    Else each of many openings would search the rest of the page in vain.
    """
    groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    return f"{pattern}|({opening}[\\s\\S]*)", f"${groups + 1}"


def with_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds lines, the trimmed, non-empty lines of a page's text; null has none. The work is linear in a page, whatever is left open in it."""
    text = F.coalesce(F.col(html), F.lit(""))
    for (pattern, _), opening in zip(MARKUP, OPENINGS, strict=False):
        text = F.regexp_replace(text, *_once(pattern, opening))
    out = pages.withColumn("_text", text)
    for pattern, to in MARKUP[len(OPENINGS) : len(OPENINGS) + 2]:
        # A tag ends with a bracket, so that none begins after the last one.
        out = out.withColumn("_open", F.substring_index("_text", ">", -1))
        out = out.withColumn("_text", F.concat(F.regexp_replace(F.expr("left(_text, length(_text) - length(_open))"), pattern, to), F.col("_open")))
    text = F.col("_text")
    for pattern, to in MARKUP[len(OPENINGS) + 2 :]:
        text = F.replace(text, F.lit(pattern), F.lit(to))
    lines = F.transform(F.split(text, "[\n\r]+"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return out.withColumn("lines", F.filter(lines, lambda x: x != "")).drop("_text", "_open")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, boiler, n (the host's pages): the lines on more than `ratio` of the host's pages; pages has host and lines.

    A host has at most its mean number of lines a page / ratio such lines, so a host's array is bounded by its pages, not by its size.
    """
    on = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("seen"))
    again = written(on.where(F.col("seen") >= min_pages), "page-lines")
    # A host's repeated lines meet its number of pages in as many tasks as they ask for.
    total = pages.groupBy("host").agg(F.count("*").alias("pages")).join(again.groupBy("host").agg(F.count("*").alias("n")), "host")
    often = dealt_join(again, total, "host", ["line"], total=again.count()).where(F.col("seen") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boiler"), F.max("pages").alias("n"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept (the lines left, in order).

    Lines on more than `ratio` of their host's pages go, if they are on `min_pages` pages at least; its default of 2 spares hosts of one page, whose
    lines are all on every page. Repeated rows are pages of their own; pages without a host (or url) share the empty host, a null html has no
    lines. A host's pages meet its boilerplate lines in as many tasks as its share of all pages asks for. Columns beside page_id, url and html are
    not used, whatever their names. A very long page is one row, handled by expressions of its lines.
    """
    own = written(with_lines(pages.select("page_id", host_of().alias("host"), "html")).select("page_id", "host", "lines"), "pages")
    both = dealt_join(own, boilerplate(own, ratio, min_pages), "host", ["page_id", "lines"], "left")
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boiler"), x)))
    both = both.withColumn("kept", kept)
    return both.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), "kept")


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_sha256."""
    return drop_boilerplate(pages).select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def _sql() -> str:
    text = "coalesce(html, '')"
    for pattern, to in MARKUP:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    return f"""
with own as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host,
    list_filter(list_transform(regexp_split_to_array({text}, '[\\n\\r]+'), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') as lines,
    row_number() over () as r
  from pages),
total as (select host, count(*) as pages from own group by host),
spread as (select host, r, unnest(list_distinct(lines)) as line from own),
often as (select s.host, s.line from spread s join total t using (host) group by s.host, s.line, t.pages having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * t.pages),
boiler as (select host, list(line) as boiler from often group by host),
kept as (select page_id, host, lines, list_filter(lines, lambda x: not list_contains(coalesce(boiler, []), x)) as kept from own left join boiler using (host))
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256
from kept"""


ORACLE = _sql()
