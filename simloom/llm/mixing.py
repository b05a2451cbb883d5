"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a hash-random key; the key's range is cut into equal buckets, so that a
source is sorted by range, bucket by bucket, and a source with a third of all rows is spread
evenly. Bucket totals give each bucket's offset in its source, a window inside the bucket gives
each document's own offset, and the source's budget cuts that order: a document is taken once
for every whole epoch the budget holds, and once more (in part, at the cut) while the rest of
the budget lasts. DataFrame operations only.

Rows of one id have one key. A bucket that is hot for that reason is split further, along the order
inside it, by key, size and a salt, as rows equal in key, id and size may change places.

Nulls: a null source is a source of its own and comes last; a null or empty text has size 0 and
gets nothing; a null id is an ordinary id. Repeated rows are documents of their own; ties in the
random order are broken by id and size, and rows equal in these are interchangeable. Long texts are
only counted. An empty table gives an empty result. Columns other than id, text and source are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a bucket of the random order holds on average.
BUCKET_ROWS = 50_000
#: Each source is cut into 2 ** LEAST_BITS buckets at least.
LEAST_BITS = 8
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
EPOCHS = 3

#: A bucket of more than so many times bucket_rows is hot; salts it is split by, besides key and size.
HOT = 8
SALTS = 64

_KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(no_source, source_, source_size, target) from rows of (no_source, source_, size).

    Water filling in closed form. In order of cap by weight the capped sources are a prefix: with
    k of them, the level of the others is (total - caps so far) / (weights left), and k is the
    least number for which the next source's cap is not below its share. Sources are few against
    documents (one row each here), so ordering them in one task is sound.
    """
    per = sizes.groupBy("no_source", "source_").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy("no_source", "source_")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "source_")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("at", F.row_number().over(by_ratio))
    )
    wide = "decimal(18,0)"
    fits = F.col("cap").cast(wide) * F.col("w_left").cast(wide) >= F.col("left").cast(wide) * F.col("w").cast(wide)
    first = F.min(F.when(fits, F.struct("at", "left", "w_left"))).over(everything)
    per = per.withColumn("first", first)
    level = F.col("first.left").cast("double") * F.col("w") / F.col("first.w_left")
    target = F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(level)
    return per.select("no_source", "source_", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Columns: id, size, source_size, target, taken (words of the document in the mix, repeats counted)."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, _KEY_BITS // 4), 16, 10).cast("long")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id_"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source_"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"),
        ),
        "mix-sizes",
    )
    bits = max(LEAST_BITS, (rows.count() // bucket_rows).bit_length())
    rows = rows.withColumn("range", F.shiftright("key", _KEY_BITS - bits))
    hot = rows.groupBy("range").agg(F.count("*").alias("rows_")).filter(F.col("rows_") > HOT * bucket_rows).select("range", F.lit(True).alias("hot"))
    finer = F.when(F.col("hot"), F.struct("key", "size", "salt"))
    rows = rows.join(bounded(materialise(hot, "hot-ranges")), "range", "left").withColumn("bucket", F.struct("range", finer.alias("finer")))
    source = ["no_source", "source_"]
    buckets = rows.groupBy(*source, "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy(*source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*source, "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_at"))
    plan = offsets.join(source_targets(buckets.select(*source, F.col("bucket_size").alias("size")), weights, epochs), source)
    inside = Window.partitionBy(*source, "bucket").orderBy("key", "id_", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.withColumn("inside_at", at).join(plan, [*source, "bucket"])
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - full * F.col("source_size") - F.col("bucket_at") - F.col("inside_at")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return placed.select(F.col("id_").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
