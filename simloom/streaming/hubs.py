"""Following the logs of hubs: hub list, checkpoints, bundles, upsert, cursors and status.

A hub's url is a folder that holds log/checkpoint and log/tile/entries/…, in any store that Spark
reads. A poll reads the checkpoints, plans the bundles past each hub's cursor, reads and classifies
them on the executors, and upserts all hubs' entries in one batch, in which the record with the
greatest (leaf_index, hub_id) of an asset wins. A bundle that is missing, cut short or of another
number of records stops its hub there: the records before it count and the cursor stays at it, so
the next poll tries it again. A poll reads `poll_bundles` of a hub at most, and the next one goes on
there; `catch_up` polls until nothing is left. A tree that has shrunk sets its hub's cursor to 0, and the next poll
reads it from the start. Cursors are written after the upsert, and upserts are idempotent, so a
record may be read twice and never lost.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.catalog import Index
from simloom.sources import tlog
from simloom.store import Files, stored
from simloom.streaming.ingest import REASONS, classify, reason_counts

_PLAN = "hub_id long, bundle long, width long, skip long, path string"


class Poller:
    """Polls the hubs of a hub list into an index; state is a folder for the cursors."""

    def __init__(self, spark: SparkSession, index: Index, hub_list: str, network: str, state: str):
        self.spark, self.index, self.hub_list, self.network, self.state = spark, index, hub_list, network, state.rstrip("/")
        self.options, self._files = index.options, Files(spark, state)
        #: The hubs polled: id to folder.
        self.hubs: dict[int, str] = {}
        known = self._saved()
        #: By hub: url, cursor, counts, last_poll (seconds), ok, error.
        self.statuses: dict[int, dict] = {int(k): v for k, v in json.loads(self._files.read(f"{self.state}/{known[-1]}")).items()} if known else {}

    def _saved(self) -> list[str]:
        return sorted((n for n in self._files.names(self.state) if re.fullmatch(r"cursors-\d+\.json", n)), key=lambda n: int(n[8:-5]))

    def _save(self) -> None:
        known = self._saved()
        after = int(known[-1][8:-5]) + 1 if known else 0
        self._files.create(f"{self.state}/cursors-{after}.json", json.dumps(self.statuses))
        for name in known[:-1]:
            self._files.delete(f"{self.state}/{name}")

    def refresh(self) -> bool:
        """Read the hub list; forget hubs that it no longer has. False, and nothing changes, if it cannot be read or is empty."""
        try:
            listed = {r["hub_id"]: r["url"] for r in tlog.hub_list(self.spark, self.hub_list, self.network).collect()}
        except Exception:  # the list known before stays
            return False
        if not listed:
            return False
        self.hubs = listed
        self.statuses = {k: v for k, v in self.statuses.items() if k in listed}
        return True

    def _sizes(self) -> dict[int, int]:
        """Tree size by hub; a hub whose checkpoint cannot be read is left out, with its error noted."""
        texts = []
        for hub, url in self.hubs.items():
            status = self.statuses.setdefault(hub, {"url": url, "cursor": 0, "counts": dict.fromkeys(REASONS, 0), "ok": None, "error": None})
            status |= {"url": url, "last_poll": time.time()}
            try:
                texts.append((hub, self._files.read(f"{url}/log/checkpoint")))
            except Exception as error:
                status |= {"ok": False, "error": f"checkpoint: {error}"}
        sizes = {}
        parsed = self.spark.createDataFrame(texts, "hub_id long, text string").select("hub_id", tlog.tree_size(F.col("text")).alias("size"))
        for row in parsed.collect():
            if row["size"] is None:
                self.statuses[row["hub_id"]] |= {"ok": False, "error": "no tree size in the checkpoint"}
            else:
                sizes[row["hub_id"]] = row["size"]
        return sizes

    def _plan(self, sizes: dict[int, int]) -> list[tuple]:
        """(hub_id, bundle, width, skip, path) to read now, at most poll_bundles of a hub."""
        rows = [(hub, self.statuses[hub]["cursor"], size, self._files.qualified(self.hubs[hub])) for hub, size in sizes.items()]
        hubs = self.spark.createDataFrame(rows, "hub_id long, last_size long, tree_size long, url string")
        most = F.floor(F.col("last_size") / tlog.WIDTH) + self.options.poll_bundles
        plan = tlog.plan_bundles(hubs.withColumn("tree_size", F.least("tree_size", most * tlog.WIDTH)))
        plan = plan.join(hubs.select("hub_id", "url"), "hub_id").withColumn("path", F.concat("url", F.lit("/log/"), tlog.entries_path(F.col("bundle"), F.col("width"))))
        return [(r["hub_id"], r["bundle"], r["width"], r["skip"], r["path"]) for r in plan.orderBy("hub_id", "bundle").collect()]

    def _records(self, plan: list[tuple]) -> DataFrame:
        """(hub_id, bundle, leaf_index, record, error) of the planned bundles; missing files are errors.

        Their folders are listed, as a call a file costs more than its records; a folder of which half is planned is read whole.
        """
        folders: dict[str, list[tuple]] = {}
        for p in plan:
            folders.setdefault(p[4].rpartition("/")[0], []).append(p)
        there, gone, paths = [], [], []
        for folder, planned in folders.items():
            names = set(self._files.names(folder))
            own = [p for p in planned if p[4].rpartition("/")[2] in names]
            gone += [(p[0], p[1], None, None, "no such bundle") for p in planned if p[4].rpartition("/")[2] not in names]
            there += own
            paths += [folder] if own and 2 * len(own) >= len(names) else [p[4] for p in own]
        gone = self.spark.createDataFrame(gone, "hub_id long, bundle long, leaf_index long, record binary, error string")
        if not there:
            return gone
        read = self.spark.read.format("binaryFile").load(paths).select("path", "content")
        expected = F.when(F.col("width") > 0, F.col("width")).otherwise(tlog.WIDTH).cast("long")
        bundles = read.join(F.broadcast(self.spark.createDataFrame(there, _PLAN)), "path").withColumn("expected", expected)
        return tlog.records(bundles).unionByName(gone)

    def poll(self) -> list[dict]:
        """Poll every hub once; returns status()."""
        sizes = self._sizes()
        for hub, size in list(sizes.items()):
            status = self.statuses[hub] | {"ok": True, "error": None}
            if size < status["cursor"]:
                status["cursor"] = 0
                del sizes[hub]
            self.statuses[hub] = status
        plan = self._plan(sizes) if sizes else []
        if plan:
            self._ingest(plan, sizes)
        self._save()
        return self.status()

    def catch_up(self) -> list[dict]:
        """Poll until no cursor moves, as a poll reads poll_bundles of a hub at most; returns status()."""
        while True:
            before = {hub: s["cursor"] for hub, s in self.statuses.items()}
            shown = self.poll()
            if before == {s["hub_id"]: s["cursor"] for s in shown}:
                return shown

    def _ingest(self, plan: list[tuple], sizes: dict[int, int]) -> None:
        read = stored(self._records(plan), "records")
        failed = {r["hub_id"]: (r["bad"]["bundle"], r["bad"]["error"]) for r in read.filter("error is not null").groupBy("hub_id").agg(F.min(F.struct("bundle", "error")).alias("bad")).collect()}
        stops = self.spark.createDataFrame([(hub, bad) for hub, (bad, _) in failed.items()], "hub_id long, stop long")
        good = read.filter("error is null").join(F.broadcast(stops), "hub_id", "left").filter("stop is null or bundle < stop")
        found = stored(classify(good.select("hub_id", "leaf_index", "record"), self.network).drop("record"), "classified")
        entries = found.filter("reason = 'ok'").withColumn("pos", F.struct("leaf_index", "hub_id"))
        try:
            self.index.upsert(entries.select("iscc_id", "iscc_code", "units", "metadata", "pos"))
        except Exception as error:
            for hub in {p[0] for p in plan}:
                self.statuses[hub] |= {"ok": False, "error": str(error)}
            return
        for hub in {p[0] for p in plan}:
            read_to = (max(p[1] for p in plan if p[0] == hub) + 1) * tlog.WIDTH
            cursor = min(read_to, sizes[hub])
            if hub in failed:
                cursor = max(self.statuses[hub]["cursor"], failed[hub][0] * tlog.WIDTH)
                self.statuses[hub] |= {"ok": False, "error": f"bundle {failed[hub][0]}: {failed[hub][1]}"}
            self.statuses[hub]["cursor"] = cursor
        for row in reason_counts(found).collect():
            counts = self.statuses[row["hub_id"]]["counts"]
            for reason in REASONS:
                counts[reason] += row[reason]

    def status(self) -> list[dict]:
        """Of each hub, by id: hub_id, url, cursor, counts, last_poll (ISO time), ok, and error, which says no more than that a poll failed."""
        shown = []
        for hub, s in sorted(self.statuses.items()):
            at = s.get("last_poll")
            shown.append({"hub_id": hub, **s, "last_poll": at and datetime.fromtimestamp(at, timezone.utc).isoformat(), "error": s["error"] and "poll failed"})
        return shown

    def run(self, stop: Callable[[], bool], wait: Callable[[float], None] = time.sleep) -> None:
        """Poll until stop() is true; the hub list is read anew after hub_refresh_seconds, or at the next poll if that failed."""
        due = 0.0
        while not stop():
            if time.monotonic() >= due:
                due = time.monotonic() + (self.options.hub_refresh_seconds if self.refresh() else 0)
            if self.hubs:
                self.poll()
            wait(self.options.poll_seconds)
