"""Log ingestion: classification of records, conversion to entries, and the streaming upsert.

Records are read at least once and upserts are idempotent, so the state is as if each were read
once. Deletions are counted and skipped: the index only ever grows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from simloom.catalog import Index
from simloom.functions import digests

#: The schemas of the two kinds of notes, and the realms of networks.
DECLARATION = "http://purl.org/iscc/schema/iscc-note-0.8.0.json"
DELETION = "http://purl.org/iscc/schema/iscc-note-delete-0.8.0.json"
REALMS = {"testnet": 0, "mainnet": 1}
REASONS = ("ok", "deletion", "unknown_schema", "malformed", "realm_mismatch")


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _entry(record: bytes | None, realm: int) -> dict:
    """reason and, for a good declaration, the entry's columns."""
    try:
        log = json.loads(record or b"")
        note = log["note"]
        schema = _text(note.get("$schema"))
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return {"reason": "malformed"}
    if schema is None:
        return {"reason": "malformed"}
    if schema != DECLARATION:
        return {"reason": "deletion" if schema == DELETION else "unknown_schema"}
    iscc_id, code, datahash = _text(log.get("iscc_id")), _text(note.get("iscc_code")), _text(note.get("datahash"))
    if digests.id_error(iscc_id):
        return {"reason": "malformed"}
    if digests.id_realm(iscc_id) != realm:
        return {"reason": "realm_mismatch"}
    listed = note.get("units") if isinstance(note.get("units"), list) else []
    own, given, instance = digests.decompose(digests.decode(code)), [digests.decode(_text(u)) for u in listed], digests.instance_of_datahash(datahash)
    if not own or instance is None or any(digests.unit_type(u) is None for u in own + given):
        return {"reason": "malformed"}
    gateway = _text(note.get("gateway"))
    return {
        "reason": "ok",
        "iscc_id": iscc_id,
        "asset_key": digests.id_key(iscc_id),
        "iscc_code": code,
        "units": [digests.canonical(u) for u in digests.longest_per_type([*own, *given, instance])],
        "metadata": json.dumps({"gateway": digests.expand_gateway(gateway, iscc_id, code, datahash)}, ensure_ascii=False, separators=(",", ":")) if gateway else None,
    }


ENTRY = T.StructType().add("reason", "string").add("iscc_id", "string").add("asset_key", "long").add("iscc_code", "string").add("units", T.ArrayType(T.StringType())).add("metadata", "string")


def classify(records: DataFrame, network: str) -> DataFrame:
    """records (…, record) with reason and, for declarations, iscc_id, asset_key, iscc_code, units, metadata.

    Units are the longest of each type among the code's, the note's and the instance unit of the
    data hash, in that order. Never fails: what cannot be read is malformed. Records are parsed in
    one function over Arrow batches: their JSON is open-ended, and each of their codes is decoded once.
    """
    realm, at = REALMS[network], records.columns.index("record")
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_entry(r, realm) for r in batch.column(at).to_pylist()]
            made = [pa.array([f.get(n) for f in found], t) for n, t in zip(ENTRY.names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *ENTRY.names])

    return records.mapInArrow(run, T.StructType(records.schema.fields + ENTRY.fields))


def reason_counts(classified: DataFrame) -> DataFrame:
    """(hub_id, ok, deletion, unknown_schema, malformed, realm_mismatch)."""
    return classified.groupBy("hub_id").agg(*(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS))


def follow(records: DataFrame, index: Index, network: str, checkpoint: str, once: bool = True, poll_seconds: int = 60) -> StreamingQuery:
    """Upsert a stream of (hub_id, leaf_index, record) into an index, a micro-batch at a time.

    In a batch the record with the greatest (leaf_index, hub_id) of an asset wins. The cursor is
    the stream's checkpoint, so a restart goes on where it ended; a failed batch is run again.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        entries = classify(batch, network).filter("reason = 'ok'")
        index.upsert(entries.select("iscc_id", "iscc_code", "units", "metadata", F.struct("leaf_index", "hub_id").alias("pos")))

    writer = records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_seconds} seconds")).start()
