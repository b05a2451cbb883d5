"""Named indexes in a shared folder: create, list, delete, upsert, load, rebuild, search, counts and sizes.

An index is a folder. Its tables (assets, units, segments) are cut into buckets by a hash of the
asset; a bucket's rows lie in a folder of their own. A generation is a manifest file that names the
folder of every bucket of every table, and the realm. A write stores its batch once, drops what is
not changed by it, rewrites the buckets that are, and then creates the next manifest, whole and
only if nobody else did: readers see the old state or the new one, and of two writers the second
fails with Conflict and may try again. Old manifests and folders go but for the last generation's.
All paths go through Hadoop's file system interface, so the folder may be in any store that Spark
reads.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import codec
from simloom.model import ASSETS, ENTRY_SIMPRINTS, SEGMENTS, UNITS, Options
from simloom.operators import search as _search
from simloom.operators import upsert as _upsert
from simloom.store import Files, stored

NAME = r"[a-z][a-z0-9]*"
TABLES = {"assets": ASSETS, "units": UNITS, "segments": SEGMENTS}
#: Order of the rows in a bucket's files, so that row groups can be skipped.
SORTED = {"assets": ("asset_key",), "units": ("unit_type", "w0"), "segments": ("sp_type", "w0", "sp")}
#: What an asset's row holds besides its segments; an update that changes none of these, nor a segment, writes nothing.
STORED = ("iscc_id", "iscc_code", "units", "metadata")


class Conflict(RuntimeError):
    """Another writer has made the next generation."""


class Result(NamedTuple):
    """Both kinds of results of one search: (query_id, asset_key, score, types, rank, iscc_id, metadata), chunk_matches with source."""

    global_matches: DataFrame
    chunk_matches: DataFrame


class Index:
    """One named index."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options, self._files = spark, path, options, Files(spark, path)

    # ---- state

    def _generations(self) -> list[int]:
        return sorted(int(m[1]) for n in self._files.names(self.path) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def manifest(self) -> dict:
        """The current generation: generation, buckets, realm, and a folder for each bucket (a number as text) of each table."""
        generations = self._generations()
        if not generations:
            raise FileNotFoundError(self.path)
        return json.loads(self._files.read(f"{self.path}/manifest-{generations[-1]}.json"))

    def _read(self, manifest: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(manifest["tables"][name].items()) if buckets is None or bucket in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str) -> DataFrame:
        return self._read(self.manifest(), name)

    @staticmethod
    def _bucket(manifest: dict) -> Column:
        return F.pmod(F.xxhash64("asset_key"), F.lit(manifest["buckets"])).cast("int")

    def _commit(self, before: dict | None, realm: int | None, tables: dict[str, DataFrame], buckets: list[str]) -> None:
        """Write the rows of the buckets given, of each table, and the manifest that follows `before`."""
        generation = before["generation"] + 1 if before else 0
        after = {"generation": generation, "buckets": before["buckets"] if before else self.options.buckets, "realm": realm}
        after["tables"] = {t: dict(before["tables"][t]) if before else {} for t in TABLES}
        folders = []
        for name, frame in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            folders.append(folder)
            # A bucket may be large: its rows are dealt over tasks, each of which writes sorted files.
            dealt = frame.withColumn("bucket", self._bucket(after)).repartition("bucket", F.pmod(F.xxhash64(*SORTED[name]), F.lit(8)))
            dealt.sortWithinPartitions("bucket", *SORTED[name]).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = {n.removeprefix("bucket=") for n in self._files.names(f"{self.path}/{folder}") if n.startswith("bucket=")}
            for bucket in buckets:
                after["tables"][name].pop(bucket, None)
            after["tables"][name] |= {bucket: f"{folder}/bucket={bucket}" for bucket in written}
        try:
            self._files.create(f"{self.path}/manifest-{generation}.json", json.dumps(after, sort_keys=True))
        except FileExistsError as error:
            for folder in folders:
                self._files.delete(f"{self.path}/{folder}")
            raise Conflict(f"generation {generation} of {self.path}") from error
        self._prune([m for m in (before, after) if m])

    def _prune(self, kept: list[dict]) -> None:
        """Delete manifests and folders that no kept generation names; folders of a later generation stay."""
        newest = max(m["generation"] for m in kept)
        old = [g for g in self._generations() if g < newest and g not in {m["generation"] for m in kept}]
        named = {f.split("/")[0] for m in kept for t in m["tables"].values() for f in t.values()}
        for g in old:
            gone = json.loads(self._files.read(f"{self.path}/manifest-{g}.json"))
            for folder in {f.split("/")[0] for t in gone["tables"].values() for f in t.values()} - named:
                self._files.delete(f"{self.path}/{folder}")
            self._files.delete(f"{self.path}/manifest-{g}.json")

    # ---- writes

    def upsert(self, batch: DataFrame) -> DataFrame:
        """Add or replace assets of (iscc_id, iscc_code, units, metadata, pos[, simprints]); returns (pos, asset_key, status).

        simprints: array of (sp_type, simprint, offset, size), text as in asset files; segments of the types
        an update has are replaced, those of other types stay. Ids must be valid and of the realm of the
        index; else ValueError and nothing is written. A batch that changes nothing writes nothing.
        """
        manifest = self.manifest()
        simprints = F.col("simprints") if "simprints" in batch.columns else F.lit(None)
        batch = batch.select(
            "pos",
            "iscc_id",
            "iscc_code",
            "units",
            "metadata",
            F.coalesce(simprints.cast(ENTRY_SIMPRINTS), F.array().cast(ENTRY_SIMPRINTS)).alias("simprints"),
            codec.id_key(F.col("iscc_id")).alias("asset_key"),
            codec.id_realm(F.col("iscc_id")).alias("realm"),
            codec.id_error(F.col("iscc_id")).alias("error"),
        )
        batch = stored(batch.withColumn("bucket", self._bucket(manifest).cast("string")), "batch")
        seen = batch.agg(F.first("error", ignorenulls=True).alias("error"), F.min("realm").alias("low"), F.max("realm").alias("high"), F.collect_set("bucket").alias("buckets")).first()
        if seen["error"]:
            raise ValueError(f"invalid id: {seen['error']}")
        realms = {r for r in (seen["low"], seen["high"], manifest["realm"]) if r is not None}
        if len(realms) > 1:
            raise ValueError("all assets of an index must be of one realm")
        batch = batch.drop("error")
        assets = self._read(manifest, "assets", seen["buckets"])
        winners = _upsert.last_of_batch(batch)
        segments = _search.segments_of(winners, "asset_key")
        prints = segments.groupBy("asset_key", "sp_type").agg(_upsert.print_of().alias("print"))
        prints = prints.groupBy("asset_key").agg(F.map_from_entries(F.collect_list(F.struct("sp_type", "print"))).alias("new_prints"))
        old = assets.select("asset_key", *(F.col(c).alias(f"old_{c}") for c in (*STORED, "prints")))
        met = winners.join(prints, "asset_key", "left").join(old, "asset_key", "left")
        no_prints = F.create_map().cast("map<string,string>")
        new_prints, old_prints = F.coalesce("new_prints", no_prints), F.coalesce("old_prints", no_prints)
        moved = F.map_filter(new_prints, lambda k, v: ~v.eqNullSafe(old_prints[k]))
        kept = F.map_filter(old_prints, lambda k, _: ~F.map_contains_key(new_prints, k))
        same = F.lit(True)
        for c in STORED:
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
        met = met.select(*winners.columns, F.map_concat(kept, new_prints).alias("prints"), F.map_keys(moved).alias("moved"), (~same | (F.size(moved) > 0)).alias("changed"))
        changed = stored(met.filter("changed").drop("changed"), "changed")
        buckets = [r["bucket"] for r in changed.select("bucket").distinct().collect()]
        status = stored(_upsert.statuses(batch, assets), "status")
        if not buckets:
            return status
        assets, units, old_segments = (self._read(manifest, t, buckets) for t in TABLES)
        new_units = _upsert.longest_units(_search.units_of(changed, "asset_key")).select(*units.columns)
        gone = _upsert.stale_instances(units, new_units).select("asset_key", "unit_type")
        kept_units = units.join(gone, ["asset_key", "unit_type"], "left_anti").select(*units.columns)
        replaced = changed.select("asset_key", F.explode("moved").alias("sp_type"))
        # Moved once, as whole assets: neither the segments' distinct rows nor their leads need another shuffle.
        moved = F.filter("simprints", lambda s: F.array_contains("moved", s["sp_type"]))
        new_segments = _search.segments_of(changed.withColumn("simprints", moved).repartition("asset_key"), "asset_key")
        kept_segments = old_segments.join(replaced, ["asset_key", "sp_type"], "left_anti")
        self._commit(
            manifest,
            realms.pop(),
            {
                "assets": _upsert.replace_keys(assets, changed.select(*assets.columns), ("asset_key",)).select(*assets.columns),
                "units": _upsert.replace_keys(kept_units, new_units, ("asset_key", "unit_type")).select(*units.columns),
                "segments": kept_segments.select(*old_segments.columns).unionByName(_upsert.with_leads(new_segments).select(*old_segments.columns)),
            },
            buckets,
        )
        return status

    def load(self, entries: DataFrame, batch_rows: int | None = None) -> tuple[DataFrame, list[str]]:
        """Upsert entries (as for upsert, with a whole number as pos) in batches of about batch_rows (the option flush_rows), in order of pos.

        Returns the statuses of the batches that were written and the errors of those that were not.
        """
        entries = stored(entries, "entries")
        n = -(-entries.count() // (batch_rows or self.options.flush_rows))
        cuts = entries.agg(F.percentile_approx("pos", [i / n for i in range(1, n)], 100_000).alias("c")).first()["c"] if n > 1 else []
        bounds = [None, *sorted(set(cuts)), None]
        statuses, errors = self.spark.createDataFrame([], entries.select("pos").schema.add("asset_key", "long").add("status", "string")), []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            part = entries if low is None else entries.filter(F.col("pos") > low)
            try:
                statuses = statuses.unionByName(self.upsert(part if high is None else part.filter(F.col("pos") <= high)))
            except Exception as error:  # a batch's failure is reported and the next one goes on
                errors.append(str(error))
        return statuses, errors

    def rebuild(self) -> None:
        """Derive the units from the assets again, and what is derived of the segments."""
        manifest = self.manifest()
        units = _upsert.longest_units(_search.units_of(self._read(manifest, "assets"), "asset_key")).select(*self._read(manifest, "units").columns)
        old = self._read(manifest, "segments")
        segments = _upsert.with_leads(old.select("asset_key", "sp_type", "sp", "offset", "size")).select(*old.columns)
        self._commit(manifest, manifest["realm"], {"units": units, "segments": segments}, [str(b) for b in range(manifest["buckets"])])

    # ---- reads

    def get(self, ids: DataFrame) -> DataFrame:
        return _search.get_assets(self.table("assets"), ids)

    def _of(self, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(the distinct keys of ids (iscc_id), a table's rows in their buckets)."""
        manifest = self.manifest()
        keys = stored(ids.select(codec.id_key(F.col("iscc_id")).alias("asset_key")).filter("asset_key is not null").distinct(), "asked")
        buckets = [str(r["b"]) for r in keys.select(self._bucket(manifest).alias("b")).distinct().collect()]
        return keys, self._read(manifest, name, buckets)

    def segments(self, ids: DataFrame) -> DataFrame:
        """(asset_key, sp_type, sp, offset, size) of the assets asked for by id (iscc_id), read from their buckets alone."""
        keys, own = self._of(ids, "segments")
        return own.select("asset_key", "sp_type", "sp", "offset", "size").join(keys, "asset_key", "left_semi")

    def contains(self, ids: DataFrame) -> DataFrame:
        """(asset_key, present) of each id (iscc_id) asked for, once; ids that are none are left out."""
        keys, own = self._of(ids, "assets")
        own = own.select("asset_key")
        return keys.join(own, "asset_key", "left_semi").withColumn("present", F.lit(True)).unionByName(keys.join(own, "asset_key", "left_anti").withColumn("present", F.lit(False)))

    def search(self, queries: DataFrame) -> DataFrame:
        """Global matches of (query_id, iscc_id, iscc_code, units)."""
        return _search.search(self.table("assets"), self.table("units"), queries, self.options)

    def search_segments(self, queries: DataFrame, exact: bool = False) -> DataFrame:
        """Chunk matches of (query_id, simprints map<type, array<text>>), with source and metadata.

        As segments are not stored with assets, a query by id has none.
        """
        asked = queries.filter("iscc_id is null") if "iscc_id" in queries.columns else queries
        asked = stored(_search.query_segments_of(asked), "query-segments")
        assets = self.table("assets")
        total = 0 if exact else assets.count()
        found = _search.search_segments(self.table("segments"), asked, total, exact, self.options)
        return _search.with_source(_search.with_metadata(_search.shown(found), assets))

    def search_all(self, queries: DataFrame, exact: bool = False) -> Result:
        """Both kinds of results of (query_id, iscc_id, iscc_code, units, simprints)."""
        return Result(self.search(queries.drop("simprints")), self.search_segments(queries, exact))

    def stats(self) -> dict:
        """assets, tracked unit types and segment types with their rows, segments' bits, and whole megabytes of tables and of all."""
        manifest = self.manifest()
        sizes = {t: sum(self._files.size(f"{self.path}/{folder}") for folder in manifest["tables"][t].values()) for t in TABLES}
        types = {r["unit_type"]: r["count"] for r in self._read(manifest, "units").groupBy("unit_type").count().collect()}
        segments = self._read(manifest, "segments").groupBy("sp_type").agg(F.count("*").alias("n"), F.max(F.octet_length("sp") * 8).alias("bits")).collect()
        return {
            "assets": self._read(manifest, "assets").count(),
            "types": types,
            "segment_types": {r["sp_type"]: r["n"] for r in segments},
            "segment_bits": {r["sp_type"]: r["bits"] for r in segments},
            "sizes": {t: n // 2**20 for t, n in sizes.items()},
            "size": sum(sizes.values()) // 2**20,
        }

    def check(self) -> DataFrame:
        """(unit_type, expected, actual) of the unit types whose rows are not those the assets ask for; rebuild mends them."""
        manifest = self.manifest()
        expected = _upsert.longest_units(_search.units_of(self._read(manifest, "assets"), "asset_key"))
        return _upsert.out_of_sync(expected, self._read(manifest, "units"), "unit_type")


class Catalog:
    """The indexes below a folder."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options, self._files = spark, path.rstrip("/"), options, Files(spark, path)

    def _at(self, name: str) -> str:
        if not re.fullmatch(NAME, name):
            raise ValueError(f"invalid index name {name!r}")
        return f"{self.path}/{name}"

    def create(self, name: str) -> Index:
        index = Index(self.spark, self._at(name), self.options)
        if index._generations():
            raise FileExistsError(name)
        index._commit(None, None, {}, [])
        return index

    def get(self, name: str) -> Index:
        index = Index(self.spark, self._at(name), self.options)
        if not index._generations():
            raise FileNotFoundError(name)
        return index

    def list(self) -> list[str]:
        """Names in order; folders without a manifest are skipped."""
        return [n for n in self._files.names(self.path) if Index(self.spark, f"{self.path}/{n}", self.options)._generations()]

    def delete(self, name: str) -> None:
        self.get(name)
        self._files.delete(self._at(name))

    def close(self) -> None:
        """Nothing is held open; may be called again."""
