"""Transparency logs: hub lists, checkpoints, bundle plans and paths, and the framed records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: records of a full bundle.
WIDTH = 256


def _parsed(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the hub list is not JSON, and no YAML reader is installed") from None
        return yaml.safe_load(text)


def hub_list(spark: SparkSession, path: str, network: str) -> DataFrame:
    """(hub_id, url) of the active hubs of a hub list, {version, network, hubs: [...]}; another network is an error.

    The list is JSON, or YAML where a YAML reader is installed.
    """
    listed = _parsed("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if listed.get("network") != network:
        raise ValueError(f"the hub list is for {listed.get('network')!r}, not {network!r}")
    rows = [(h["hub_id"], h["url"].rstrip("/"), bool(h.get("active"))) for h in listed["hubs"]]
    return spark.createDataFrame(rows, "hub_id int, url string, active boolean").filter("active").select("hub_id", "url")


def tree_size(checkpoint: Column) -> Column:
    """Tree size of a checkpoint's text: a plain decimal on the second of three lines or more; else null."""
    lines = F.split(checkpoint, "\n")
    second = F.get(lines, F.lit(1))
    return F.when((F.size(lines) >= 3) & second.rlike(r"^(?:0|[1-9][0-9]*)$"), second.try_cast("long"))


def plan_bundles(hubs: DataFrame) -> DataFrame:
    """(hub_id, bundle, width, skip) that cover [last_size, tree_size) of each hub.

    width is 0 for a full bundle; skip counts the records of the first one that were read before.
    """
    first = F.floor(F.col("last_size") / WIDTH)
    last = F.floor((F.col("tree_size") - 1) / WIDTH)
    plans = hubs.filter("tree_size > last_size").select("hub_id", "last_size", "tree_size", F.explode(F.sequence(first, last)).alias("bundle"))
    end = (F.col("bundle") + 1) * WIDTH
    width = F.when(end <= F.col("tree_size"), 0).otherwise(F.col("tree_size") - F.col("bundle") * WIDTH)
    return plans.select("hub_id", "bundle", width.cast("long").alias("width"), F.greatest(F.lit(0), F.col("last_size") - F.col("bundle") * WIDTH).cast("long").alias("skip"))


def next_cursor(last_size: Column, size: Column) -> Column:
    """Where a poll starts: from 0 again when the tree has shrunk."""
    return F.when(size < last_size, F.lit(0)).otherwise(last_size).cast("long")


def entries_path(bundle: Column, width: Column) -> Column:
    """tile/entries/ path of a bundle: digits in threes, all groups but the last with an x, .p/<width> if partial."""
    digits = bundle.cast("string")
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 3) * 3).cast("int"), F.lit("0"))
    groups = F.regexp_replace(padded, r"(\d{3})(?=\d)", "x$1/")
    return F.concat(F.lit("tile/entries/"), groups, F.when(width > 0, F.concat(F.lit(".p/"), width.cast("string"))).otherwise(F.lit("")))


def frame_records(records: list[bytes]) -> bytes:
    return b"".join(len(r).to_bytes(2, "big") + r for r in records)


def split_bundle(data: bytes) -> list[bytes]:
    """Records of a bundle: a 16-bit big-endian length before each."""
    out, at = [], 0
    view = memoryview(data)
    while at < len(view):
        head = bytes(view[at : at + 2])
        record = bytes(view[at + 2 : at + 2 + int.from_bytes(head, "big")])
        if len(head) < 2 or len(record) < int.from_bytes(head, "big"):
            raise ValueError("truncated bundle")
        out.append(record)
        at += 2 + len(record)
    return out


def records(bundles: DataFrame) -> DataFrame:
    """(hub_id, bundle, leaf_index, record, error) of (hub_id, bundle, expected, skip, content).

    A truncated bundle, or one of another number of records than expected, gives one row with an
    error and no record, so that the caller keeps its cursor. Records read before are skipped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for hub, bundle, expected, skip, content in frame.itertuples(index=False):
                try:
                    found = split_bundle(bytes(content))
                    if len(found) != expected:
                        raise ValueError(f"{len(found)} records, expected {expected}")
                except ValueError as error:
                    out.append((hub, bundle, None, None, str(error)))
                    continue
                out += [(hub, bundle, bundle * WIDTH + i, r, None) for i, r in enumerate(found) if i >= skip]
            result = pd.DataFrame(out, columns=["hub_id", "bundle", "leaf_index", "record", "error"])
            result["leaf_index"] = result["leaf_index"].astype("Int64")
            yield result

    return bundles.select("hub_id", "bundle", "expected", "skip", "content").mapInPandas(run, "hub_id long, bundle long, leaf_index long, record binary, error string")
