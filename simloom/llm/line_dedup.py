"""Line dedup by site-relative frequency.

Per host, the share of its pages that contain a line (after trimming blanks) is the number of
such pages divided by the host's pages. A line is boilerplate on a host where at least
`min_pages` pages hold it and that share exceeds `ratio`; it is dropped from every page of that
host. Counts cover all pages: a line is counted once a page, summed in map tasks before the
shuffle, so a line that a third of all rows share costs one row a task. Lines are counted by their
128-bit hashes, so whole lines are never moved.

Lines of over LONG_WORDS words are seldom repeated by chance. With `long_permille` such a line has
a bar of its own: that share of the host's pages, in thousandths, and still `min_pages`.

A host has at most (lines a page on average) / ratio boilerplate lines (of either length, by its
own ratio), so their hashes are gathered in one array a host. The arrays are broadcast if hosts and
bytes were counted to be few, else joined with the pages by host and a salt of the row, which spreads
a hot host over `salts` tasks.

Nulls: a null text stays null and holds no line; a null host is a host of its own; blank lines
are never boilerplate. Repeated rows are pages of their own; a line either passes the bar or not, so
there are no ties. Long texts are split whole. Empty tables give empty results. Columns other than
the text are handed through as they are, whatever their names, but for those of N_LINES and N_KEPT,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

RATIO_PERCENT = 10
MIN_PAGES = 3
#: Lines of more words are passages; the bar for them where one is asked for.
LONG_WORDS = 50
LONG_PERMILLE = 5
#: Hosts whose boilerplate may be broadcast.
BROADCAST_HOSTS = 10_000
BLANKS = " \t\r"
#: Columns that are added: lines before and after.
N_LINES, N_KEPT = "__ld_n_lines", "__ld_n_kept"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without a www. in front; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def boilerplate(pages: DataFrame, host: Column, text: Column, percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES, long_permille: int | None = None) -> DataFrame:
    """(host_, lines_): MD5 (hex) of each host's boilerplate lines; hosts without any are left out."""
    keys = F.filter(F.array_distinct(F.transform(F.coalesce(_lines(text), F.array().cast("array<string>")), _key)), lambda x: x != "")
    long = F.lit(False) if long_permille is None else F.size(F.split("line_", r"\s+")) > LONG_WORDS
    own = pages.select(host.alias("host_"), keys.alias("own_"))
    totals = own.groupBy("host_").agg(F.count("*").alias("pages_"))
    lines = own.select("host_", F.explode("own_").alias("line_")).select("host_", F.unhex(F.md5("line_")).alias("hash_"), long.alias("long_"))
    lines = lines.groupBy("host_", "hash_", "long_").agg(F.count("*").alias("with_")).filter(F.col("with_") >= min_pages)
    lines, totals = lines.alias("l"), totals.alias("t")
    enough = F.col("with_") * 100 > F.col("pages_") * percent
    if long_permille is not None:
        enough = enough | (F.col("long_") & (F.col("with_") * 1000 > F.col("pages_") * long_permille))
    common = lines.join(totals, F.col("l.host_").eqNullSafe(F.col("t.host_"))).filter(enough)
    return common.groupBy(F.col("l.host_").alias("host_")).agg(F.sort_array(F.collect_list(F.lower(F.hex("hash_")))).alias("lines_"))


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    percent: int = RATIO_PERCENT,
    min_pages: int = MIN_PAGES,
    salts: int = 32,
    broadcast_hosts: int = BROADCAST_HOSTS,
    long_permille: int | None = None,
) -> DataFrame:
    """pages with the boilerplate lines gone from text_col, with N_LINES and N_KEPT."""
    own_names = "__ld_"
    while any(c.startswith(own_names) for c in pages.columns if c not in (N_LINES, N_KEPT)):
        own_names = f"_{own_names}"
    page_host, found_host, drops, salt, salted, drop, kept = (f"{own_names}{c}" for c in ("page_host", "found_host", "drops", "salt", "salted", "drop", "kept"))
    found = materialise(boilerplate(pages, host, F.col(text_col), percent, min_pages, long_permille), "boilerplate").toDF(found_host, drops)
    own = pages.withColumn(page_host, host)
    hinted = bounded(found, broadcast_hosts)
    if hinted is not found:
        joined = own.join(hinted, F.col(page_host).eqNullSafe(F.col(found_host)), "left")
    else:
        own = own.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        spread = found.withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = own.join(spread, F.col(page_host).eqNullSafe(F.col(found_host)) & (F.col(salt) == F.col(salted)), "left").drop(salt, salted)
    lines = _lines(F.col(text_col))
    # A page's own boilerplate first, by hashing; then its lines are looked up in that short list.
    own_drops = F.array_intersect(F.transform(lines, lambda x: F.md5(_key(x))), F.col(drops))
    joined = joined.withColumn(drop, F.when(F.size(drops) > 0, own_drops))
    rest = F.filter(lines, lambda x: ~F.array_contains(drop, F.md5(_key(x))))
    joined = joined.withColumn(kept, F.when(F.coalesce(F.size(drop), F.lit(0)) > 0, rest).otherwise(lines))
    joined = joined.withColumn(N_LINES, F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn(N_KEPT, F.coalesce(F.size(kept), F.lit(0)).cast("long"))
    # Only texts that hold a boilerplate line are rebuilt, so others come out byte for byte as they were.
    return joined.withColumn(text_col, F.when(F.col(N_LINES) == F.col(N_KEPT), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(page_host, found_host, drops, drop, kept)
