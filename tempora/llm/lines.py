"""Site-relative line removal: lines that stand on a large share of a host's pages are boilerplate there.

A host's lines are counted once a page, the count divided by the host's number of pages. A line above RATIO goes, on
that host only. Every page lets its distinct lines in, so a host has at most (mean distinct lines a page) / RATIO such
lines: the table of boilerplate has a bounded row for each host, whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tempora.llm.text import WORD
from tempora.session import materialize

#: A line goes from a host if more than this share of the host's pages have it ...
RATIO = 0.1
#: ... and at least so many: the ratio alone decides, but a line of one page is not shared.
MIN_PAGES = 2


def html_lines(html: Column) -> Column:
    """The stretches of text between tags; comments, scripts and style sheets are left out."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    return F.split(F.regexp_replace(shown, "<[^>]*>", "\n"), "\n", -1)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without port; NULL if there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def _site(host: Column) -> Column:
    """A host as text that is never NULL."""
    return F.when(host.isNull(), "").otherwise(F.concat(F.lit("="), host.cast("string")))


def _keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, drop): the hashes of each host's boilerplate lines."""
    own = pages.select(_site(host).alias("site"), lines.alias("lines")) \
        .select("site", F.array_distinct(_keys(F.filter("lines", _has_word))).alias("keys"))
    # the key NULL counts the pages themselves
    counts = materialize(
        own.select("site", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key"))
        .groupBy("site", "key").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("key").isNull()), "lines")
    total = counts.where("key IS NULL").select("site", F.col("n").alias("pages"))
    return counts.where("key IS NOT NULL").join(total, "site").where(F.col("n") > ratio * F.col("pages")) \
        .groupBy("site").agg(F.sort_array(F.collect_list("key")).alias("drop"))


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, lines, kept): every input row as a struct, its lines, and the lines that stay, in order.

    A NULL host is a host of its own, NULL text has no lines. Lines without a word neither count nor go. Each row is a
    page, repeated rows too. Input columns live inside ``row``, so their names cannot clash.
    """
    drop = materialize(boilerplate(pages, host, lines, ratio, min_pages), "boilerplate")
    own = pages.select(F.struct(*pages.columns).alias("row"), _site(host).alias("site"), lines.alias("lines"))
    found = own.join(drop, "site", "left").select(
        "row", "lines", F.array_intersect(_keys("lines"), F.coalesce("drop", F.array().cast("array<long>"))).alias("found"))
    return found.select("row", "lines", F.when(F.size("found") == 0, F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~(F.array_contains(F.col("found"), F.xxhash64(x)) & _has_word(x)))).alias("kept"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """The text lines of web pages (page_id, url, html) without their host's boilerplate."""
    done = drop_boilerplate(pages.select("page_id", "url", "html"), host_of(F.col("url")), html_lines(F.col("html")))
    shown = lambda c: F.filter(c, _has_word)
    return done.select(F.col("row.page_id").alias("page_id"), F.array_join(shown("kept"), "\n").alias("text"),
                       F.size(shown("lines")).cast("long").alias("n_lines"), F.size(shown("kept")).cast("long").alias("n_kept"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents without the lines that are boilerplate in their source; ``n_chars`` follows, where there is one."""
    done = drop_boilerplate(docs, F.col("source"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    new = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.array_join("kept", "\n"))
    made = {"text": new, "n_chars": F.length(new).cast("long")}
    return done.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("page_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"),
                          F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '') AS host,
    list_filter(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p) GROUP BY ALL),
b AS (SELECT c.host, list(line) AS gone FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n > 0.1 * pages AND n >= 2 GROUP BY c.host),
k AS (SELECT page_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
