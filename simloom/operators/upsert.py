"""Upserts: statuses, last-wins batches, replacement of units and segments, rebuilds and checks.

All are frame-to-frame: the new state of a table is the old one without the keys of the batch
(anti-join) and the batch's rows. `simloom.catalog` writes states atomically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.codec import words


def print_of() -> Column:
    """Aggregate: one value of a set of segments (sp, offset, size), whatever their order."""
    one = F.concat_ws(":", F.hex("sp"), "offset", "size")
    return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(one))), 256)


def fingerprint(segments: DataFrame) -> DataFrame:
    """(asset_key, sp_type, fingerprint) of (asset_key, sp_type, sp, offset, size), whatever the order of rows."""
    return segments.groupBy("asset_key", "sp_type").agg(print_of().alias("fingerprint"))


def with_leads(segments: DataFrame) -> DataFrame:
    """segments with their words w0..w3 and lead: the first in byte order at a (sp_type, asset, offset, size)."""
    place = Window.partitionBy("sp_type", "asset_key", "offset", "size").orderBy("sp")
    own = segments.withColumn("lead", F.row_number().over(place) == 1)
    return own.withColumns({f"w{i}": w for i, w in enumerate(words(F.col("sp")))})


def statuses(batch: DataFrame, assets: DataFrame) -> DataFrame:
    """(pos, asset_key, status) a row of the batch: created at the first sight of a key, else updated."""
    first = F.row_number().over(Window.partitionBy("asset_key").orderBy("pos")) == 1
    known = assets.select("asset_key").distinct().withColumn("known", F.lit(True))
    seen = batch.select("pos", "asset_key", first.alias("first")).join(known, "asset_key", "left")
    return seen.select("pos", "asset_key", F.when(F.col("first") & F.col("known").isNull(), "created").otherwise("updated").alias("status"))


def last_of_batch(batch: DataFrame) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy("asset_key").orderBy(F.desc("pos"))
    return batch.withColumn("at_", F.row_number().over(order)).filter("at_ = 1").drop("at_")


def realm_conflicts(assets: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows (realm, n) if batch and assets hold more than one realm, else none. Frames have a realm column."""
    realms = assets.select("realm").union(batch.select("realm")).groupBy("realm").agg(F.count("*").alias("n"))
    return realms.withColumn("realms", F.count("*").over(Window.partitionBy())).filter("realms > 1").select("realm", "n")


def changed(winners: DataFrame, assets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Winners that are new or differ from the stored asset in a column; the rest need no write."""
    old = assets.select(F.col("asset_key").alias("old_key"), *(F.col(c).alias(f"old_{c}") for c in columns))
    met = winners.join(old, winners["asset_key"] == old["old_key"], "left")
    differs = F.col("old_key").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return met.filter(differs).select(winners.columns)


def replace_keys(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old without the rows whose keys occur in new, and new: replaces assets, units or segments by key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def append_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """Units are only ever added: no row twice."""
    return old.unionByName(new).dropDuplicates(["unit_type", "body", "asset_key"])


def stale_instances(old: DataFrame, new: DataFrame) -> DataFrame:
    """Instance units of updated assets that the update no longer has. Frames (asset_key, unit_type, body)."""
    touched = old.filter(F.col("unit_type").startswith("INSTANCE_")).join(new.select("asset_key").distinct(), "asset_key", "left_semi")
    return touched.join(new, ["asset_key", "unit_type", "body"], "left_anti")


def first_per_place(segments: DataFrame) -> DataFrame:
    """Of the segments of a batch at one (sp_type, asset_key, offset, size) the first by pos."""
    order = Window.partitionBy("sp_type", "asset_key", "offset", "size").orderBy("pos")
    return segments.withColumn("at_", F.row_number().over(order)).filter("at_ = 1").drop("at_")


def longest_units(units: DataFrame) -> DataFrame:
    """Rebuild: of each asset and unit type the longest body, of equals the last by unit_pos."""
    order = Window.partitionBy("asset_key", "unit_type").orderBy(F.desc("nbits"), F.desc("unit_pos"))
    return units.withColumn("at_", F.row_number().over(order)).filter("at_ = 1").drop("at_")


def out_of_sync(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """(type, expected, actual) of the types whose row counts differ."""
    a = expected.groupBy(column).agg(F.count("*").alias("expected"))
    b = actual.groupBy(F.col(column).alias("b_")).agg(F.count("*").alias("actual"))
    met = a.join(b, a[column] == b["b_"], "full").select(F.coalesce(column, "b_").alias(column), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return met.filter("expected <> actual")


def summary(results: DataFrame, errors: int = 0) -> DataFrame:
    """One row: added, created, updated, errors."""
    return results.agg(
        F.count("*").alias("added"),
        F.count(F.when(F.col("status") == "created", 1)).alias("created"),
        F.count(F.when(F.col("status") == "updated", 1)).alias("updated"),
        F.lit(errors).cast("long").alias("errors"),
    )


def entry_json(columns: list[Column]) -> Column:
    """An entry as JSON without nulls."""
    return F.to_json(F.struct(*columns))
