"""Spans of regular expressions in whole texts, with DataFrame functions only.

`scan` reads each text once and keeps, for every kind, the matches and the lengths of the gaps
between them; `positions` turns these into code point positions by running sums. The scan is
stored in the shared folder, so that texts are not read again, and each row gets a number there,
which tells repeated rows apart.

Patterns are Java regular expressions whose loops over groups are possessive and whose starts are
anchored to the start of a run (or to the end of the match before it), so that no text costs more
than a fixed number of passes and long runs do not exhaust the stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Kind:
    """A kind of span. cheap: a pattern that every text with a match contains."""

    name: str
    pattern: str
    cheap: str | None = None


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.rlike(kind.cheap), found) if kind.cheap else found


def _item(gaps: Column, context: int):
    def item(value: Column, k: Column) -> Column:
        gap = F.get(gaps, k)
        before = F.substring(gap, -context, context) if context else F.lit("")
        return F.struct(F.char_length(gap).alias("gap"), value.alias("value"), before.alias("before"))

    return item


def scan(docs: DataFrame, id_col: str, text_col: str, kinds: list[Kind], context: int = 0) -> DataFrame:
    """Stored rows (row_, id_, kinds_): kinds_ has one entry a kind that occurs in the text.

    An entry is (order, kind, items), an item (gap, value, before): characters since the end of
    the match before it, the match, and the last `context` characters of the gap.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    for i, kind in enumerate(kinds):
        rows = rows.withColumn(f"found{i}_", _matches(F.col("text_"), kind))
    for i, kind in enumerate(kinds):
        rows = rows.withColumn(f"gaps{i}_", F.when(F.size(f"found{i}_") > 0, F.split("text_", kind.pattern, -1)))
    entries = []
    for i, kind in enumerate(kinds):
        items = F.transform(f"found{i}_", _item(F.col(f"gaps{i}_"), context))
        entries.append(F.when(F.size(f"found{i}_") > 0, F.struct(F.lit(i).alias("order"), F.lit(kind.name).alias("kind"), items.alias("items"))))
    return materialise(rows.select("row_", "id_", F.array_compact(F.array(*entries)).alias("kinds_")), "spans")


def positions(scanned: DataFrame) -> DataFrame:
    """(row_, order, kind, start, end, value, before), a row a match."""
    flat = scanned.select("row_", F.explode("kinds_").alias("k")).select("row_", "k.order", "k.kind", F.posexplode("k.items").alias("at", "item"))
    flat = flat.select("row_", "order", "kind", "at", "item.*")
    so_far = Window.partitionBy("row_", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.char_length("value")).over(so_far)
    return flat.withColumn("end", end.cast("long")).select("row_", "order", "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value", "before")


def overlaps_any(base: Column) -> Column:
    """Whether a span overlaps one that satisfies base, in a frame of (row_, start, end, ...)."""
    ordered = Window.partitionBy("row_").orderBy("start", "end")
    left = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False))


def joined(spans: Column) -> Column:
    """kind:start:end of an array of (start, order, end, kind), sorted and comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def per_document(scanned: DataFrame, spans: DataFrame, base: list[str], id_col: str) -> DataFrame:
    """A row a document: id, n_<kind> of each base kind, base (joined base spans), spans (all, joined).

    spans: (row_, order, kind, start, end); the kinds in base come first in order.
    """
    one = F.struct("start", "order", "end", "kind")
    grouped = spans.groupBy("row_").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base),
        joined(F.collect_list(F.when(F.col("kind").isin(base), one))).alias("base"),
        joined(F.collect_list(one)).alias("spans"),
    )
    out = scanned.select("row_", "id_").join(grouped, "row_", "left")
    counts = (F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base)
    return out.select(F.col("id_").alias(id_col), *counts, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
