"""Engine tables derived from the driver's tables, and the same as SQL.

Content units are the sign bits of embeddings (32 bits for every third vector, else 64), instance
units and segments are hashes of texts, the stored query set is every row whose id is divisible
by 20.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import codec
from simloom.sources import tlog
from simloom.store import Files

CONTENT_TYPE, INSTANCE_TYPE, SEGMENT_TYPE, VECTOR_TYPE = "CONTENT_TEXT_V0", "INSTANCE_NONE_V0", "CONTENT_TEXT_V0", "SEMANTIC_TEXT_V0"
EVERY = 20
WINDOW = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign_bits(vector: Column) -> Column:
    """Hex of the sign bits of 64 floats."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.concat(*(F.lpad(F.lower(F.conv(F.substring(bits, 1 + 32 * i, 32), 2, 16)), 8, "0") for i in range(2)))


def _with_words(frame: DataFrame, hexed: Column, nbits: Column, unit_type: str) -> DataFrame:
    body = F.unhex(F.substring(hexed, F.lit(1), (nbits / 4).cast("int")))
    frame = frame.withColumn("unit_type", F.lit(unit_type)).withColumn("nbits", nbits.cast("int")).withColumn("body", body)
    return frame.select("asset_key", "unit_type", "nbits", *(w.alias(f"w{i}") for i, w in enumerate(codec.words(F.col("body")))), "body")


def content_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_key"), sign_bits(F.col("embedding")).alias("h"))
    return _with_words(rows, F.col("h"), F.when(F.col("asset_key") % 3 == 0, 32).otherwise(64), CONTENT_TYPE)


def instance_units(spark: SparkSession, sf_dir: str, query: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_key"), F.sha2("text", 256).alias("h"))
    stored = (F.col("asset_key") % 4 + 1) * 64
    asked = F.when(F.floor(F.col("asset_key") / EVERY) % 2 == 0, 256).otherwise(128)
    return _with_words(rows, F.col("h"), asked if query else stored, INSTANCE_TYPE)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_units(spark, sf_dir).unionByName(instance_units(spark, sf_dir))


def query_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = content_units(spark, sf_dir).unionByName(instance_units(spark, sf_dir, query=True)).filter(F.col("asset_key") % EVERY == 0)
    return both.withColumnRenamed("asset_key", "query_id").withColumn("unit_pos", F.when(F.col("unit_type") == CONTENT_TYPE, 0).otherwise(1))


UNITS_SQL = f"""
emb as (select vec_id as k, lower(lpad(to_hex(list_sum(list_transform(range(32), lambda i: case when embedding[i + 1] > 0 then 1::bigint << (31 - i) else 0 end))::bigint), 8, '0')
    || lpad(to_hex(list_sum(list_transform(range(32), lambda i: case when embedding[32 + i + 1] > 0 then 1::bigint << (31 - i) else 0 end))::bigint), 8, '0')) as h from embeddings),
docs as (select doc_id as k, sha256(text) as h from documents),
cu as (select k, '{CONTENT_TYPE}' as t, n, substr(h, 1, n // 4) as b from (select *, case when k % 3 = 0 then 32 else 64 end as n from emb)),
iu as (select k, '{INSTANCE_TYPE}' as t, n, substr(h, 1, n // 4) as b from (select *, (k % 4 + 1) * 64 as n from docs)),
qc as (select k as q, t, n, b from cu where k % {EVERY} = 0),
qi as (select k as q, t, n, substr(h, 1, n // 4) as b from (select *, '{INSTANCE_TYPE}' as t, case when (k // {EVERY}) % 2 = 0 then 256 else 128 end as n from docs where k % {EVERY} = 0))
"""


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_key, sp_type, sp, offset, size): 64-bit hashes of windows of eight words."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("asset_key"), words.alias("w"))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(WINDOW))))
    part = F.slice("w", F.col("offset") + 1, F.lit(WINDOW))
    return rows.select("asset_key", F.lit(SEGMENT_TYPE).alias("sp_type"), F.unhex(F.substring(F.md5(F.array_join(part, " ")), 1, 16)).alias("sp"), F.col("offset").cast("long").alias("offset"), F.size(part).cast("long").alias("size"))


def two_kinds_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words and, as another type, of twice as many."""
    first = text_segments(spark, sf_dir)
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("asset_key"), words.alias("w"))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(2 * WINDOW))))
    part = F.slice("w", F.col("offset") + 1, F.lit(2 * WINDOW))
    second = rows.select("asset_key", F.lit(VECTOR_TYPE).alias("sp_type"), F.unhex(F.substring(F.md5(F.array_join(part, " ")), 1, 16)).alias("sp"), F.col("offset").cast("long").alias("offset"), F.size(part).cast("long").alias("size"))
    return first.unionByName(second)


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents for an index: codes, metadata and two kinds of segments; their place is the document's id."""
    own = assets(spark, sf_dir).filter("iscc_code is not null").withColumn("doc_id", F.shiftright("asset_key", 12) - 1_000_000)
    one = F.struct("sp_type", codec.encode_simprint(F.col("sp")).alias("simprint"), "offset", "size")
    listed = two_kinds_of_segments(spark, sf_dir).groupBy(F.col("asset_key").alias("doc_id")).agg(F.collect_list(one).alias("simprints"))
    return own.join(listed, "doc_id", "left").select("iscc_id", "iscc_code", "units", "metadata", "simprints", F.col("doc_id").alias("pos"))


def segment_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, simprints): the segments of every twentieth document, each once, by type."""
    own = query_segments(two_kinds_of_segments(spark, sf_dir))
    listed = own.groupBy("query_id", "sp_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("sp_pos", "sp"))), lambda x: codec.encode_simprint(x["sp"])).alias("l"))
    return listed.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("sp_type", "l"))).alias("simprints"))


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors an asset, a segment each."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 5).alias("asset_key"), F.lit(VECTOR_TYPE).alias("sp_type"), F.unhex(sign_bits(F.col("embedding"))).alias("sp"), (F.col("vec_id") % 5).alias("offset"), F.lit(1).cast("long").alias("size"))


def query_segments(segments: DataFrame) -> DataFrame:
    """(query_id, sp_pos, sp_type, sp): the segments of every twentieth asset, each once."""
    own = segments.filter(F.col("asset_key") % EVERY == 0)
    own = own.groupBy(F.col("asset_key").alias("query_id"), "sp_type", "sp").agg(F.min("offset").alias("sp_pos"))
    return own.select("query_id", "sp_pos", "sp_type", "sp")


SEGMENTS_SQL = f"""
ts as (select doc_id as k, '{SEGMENT_TYPE}' as t, substr(md5(array_to_string(list_slice(w, o + 1, o + {WINDOW}), ' ')), 1, 16) as s, o, len(list_slice(w, o + 1, o + {WINDOW})) as z
  from (select doc_id, w, unnest(range(0, len(w), {WINDOW})) as o from (select doc_id, string_split(text, ' ') as w from documents where text is not null))),
vs as (select k // 5 as k, '{VECTOR_TYPE}' as t, h as s, k % 5 as o, 1 as z from emb),
qts as (select k as q, t, s, min(o) as p from ts where k % {EVERY} = 0 group by k, t, s),
qvs as (select k as q, t, s, min(o) as p from vs where k % {EVERY} = 0 group by k, t, s)
"""


def exact_of_type_sql(name: str, window: int, kind: str) -> str:
    """Exact scores of one segment type: {name}_sc (q, k, matches, n_q, s), the best forty of a query in {name}_top."""
    return f"""
{name}_ts as (select doc_id as k, substr(md5(array_to_string(list_slice(w, o + 1, o + {window}), ' ')), 1, 16) as s, o, len(list_slice(w, o + 1, o + {window})) as z
  from (select doc_id, w, unnest(range(0, len(w), {window})) as o from (select doc_id, string_split(text, ' ') as w from documents where text is not null))),
{name}_q as (select k as q, s from {name}_ts where k % {EVERY} = 0 group by k, s),
{name}_hits as (select * from (select q, s, k, o, z, row_number() over (partition by q, s order by k, o, z) as r from {name}_ts join {name}_q using (s)) where r <= 1000),
{name}_df as (select q, s, count(distinct k) as f from {name}_hits group by q, s),
{name}_per as (select q, k, s, any_value(f) as f, count(*) as n from {name}_hits join {name}_df using (q, s) group by q, k, s),
{name}_nq as (select q, count(*) as n_q from {name}_q group by q),
{name}_agg as (select q, k, count(*) as found, sum(n) as matches, avg(1.0::double / f) as m, min(1.0::double / f) as lo, max(1.0::double / f) as hi from {name}_per group by q, k),
{name}_sc as (select q, k, matches, n_q, found::double / n_q * case when lo = hi then 1 else (m - lo) / (hi - lo) end as s from {name}_agg join {name}_nq using (q)),
{name}_top as (select *, '{kind}' as t from (select *, row_number() over (partition by q order by round(s, 9) desc, k) as r from {name}_sc where round(s, 9) >= 0.65) where r <= 40)"""


def ids(key: Column) -> Column:
    """Asset ids of the fixtures: realm 0."""
    return codec.id_from_key(F.shiftleft(key + 1_000_000, 12), 0)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of documents: a code of a data and an instance unit of 128 bits each, and metadata."""
    h = F.sha2("text", 256)
    data = F.concat(codec.header(codec.DATA, 0, 0, 3), F.unhex(F.substring(h, 1, 32)))
    instance = F.concat(codec.header(codec.INSTANCE, 0, 0, 3), F.unhex(F.substring(h, 33, 32)))
    key = F.shiftleft(F.col("doc_id") + 1_000_000, 12)
    return table(spark, sf_dir, "documents").select(
        key.alias("asset_key"),
        ids(F.col("doc_id")).alias("iscc_id"),
        F.lit(0).alias("realm"),
        codec.canonical(codec.compose(F.array(data, instance))).alias("iscc_code"),
        F.array(codec.canonical(data), codec.canonical(instance)).alias("units"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
    )


def base32_sql(hexed: str) -> str:
    """DuckDB expression: base32 text of a hex string."""
    groups = f"list_transform(range((length({hexed}) + 9) // 10), lambda g: ('0x' || rpad(substr({hexed}, (10 * g + 1)::int, 10), 10, '0'))::bigint)"
    digits = f"list_transform({groups}, lambda v: array_to_string(list_transform(range(8), lambda j: substr('{codec.BASE32}', (((v >> (35 - 5 * j)::int) & 31) + 1)::int, 1)), ''))"
    return f"substr(array_to_string({digits}, ''), 1, ((length({hexed}) * 4 + 4) // 5)::int)"


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hub_id, leaf_index, record): a log of each of two hubs from events; the kind of record follows the event's id."""
    e = table(spark, sf_dir, "events")
    key, kind = F.col("event_id"), F.col("event_id") % 7
    h = F.sha2(key.cast("string"), 256)
    content = F.concat(codec.header(codec.CONTENT, 0, 0, 1), F.unhex(F.substring(h, 1, 16)))
    data = F.concat(codec.header(codec.DATA, 0, 0, 1), F.unhex(F.substring(h, 17, 16)))
    instance = F.concat(codec.header(codec.INSTANCE, 0, 0, 1), F.unhex(F.substring(h, 1, 16)))
    code = codec.canonical(codec.compose(F.array(content, data, instance)))
    long_data = codec.canonical(F.concat(codec.header(codec.DATA, 0, 0, 3), F.unhex(F.substring(h, 17, 32))))
    realm = F.when(kind == 6, 1).otherwise(0)
    iscc_id = codec.id_from_key(F.shiftleft(F.col("user_id") + 5_000, 12), realm)
    schema = F.when(kind == 3, "http://purl.org/iscc/schema/iscc-note-delete-0.8.0.json").when(kind == 4, "http://example.com/other.json").otherwise("http://purl.org/iscc/schema/iscc-note-0.8.0.json")
    note = F.struct(schema.alias("$schema"), code.alias("iscc_code"), F.concat(F.lit("1e20"), h).alias("datahash"), F.when(kind == 1, "https://{iscc_id}.x{/datahash}").alias("gateway"), F.array(long_data).alias("units"))
    record = F.when(kind == 5, F.lit("{not json")).otherwise(F.to_json(F.struct(iscc_id.alias("iscc_id"), note.alias("note"))))
    return e.select((F.col("event_id") % 2).alias("hub_id"), F.floor(F.col("event_id") / 2).alias("leaf_index"), record.cast("binary").alias("record"), "user_id", "event_id")


def _written(bundles: DataFrame, folder: str) -> DataFrame:
    """(hub_id, n) of (hub_id, n, path, content) once the files are there: executors write them to a folder that all share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{folder}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                beside = f"{at}.{uuid.uuid4().hex}.tmp"
                with open(beside, "wb") as file:
                    file.write(content)
                os.replace(beside, at)
            yield batch.select(["hub_id", "n"])

    return bundles.mapInArrow(run, "hub_id long, n long")


def log_folders(spark: SparkSession, sf_dir: str, at: str) -> str:
    """The logs of log_records as folders of hubs below `at`, and a hub list, whose path is returned."""
    log = log_records(spark, sf_dir).select("hub_id", "leaf_index", "record")
    # A task has about 64 bundles, as they leave it in Arrow batches.
    log = log.repartition(log.count() // (64 * tlog.WIDTH) + 1, "hub_id", F.floor(F.col("leaf_index") / tlog.WIDTH))
    framed = F.concat(F.lpad(F.hex(F.octet_length("record").cast("long")), 4, "0"), F.hex("record"))
    bundles = log.groupBy("hub_id", F.floor(F.col("leaf_index") / tlog.WIDTH).alias("bundle")).agg(F.count("*").alias("n"), F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf_index", framed.alias("f")))), lambda x: x["f"]), "")).alias("content"))
    width = F.when(F.col("n") < tlog.WIDTH, F.col("n")).otherwise(0)
    bundles = bundles.select("hub_id", "n", F.concat(F.lit("hub"), "hub_id", F.lit("/log/"), tlog.entries_path(F.col("bundle"), width)).alias("path"), "content")
    files, sizes = Files(spark, at), {}
    root = files.qualified(at)
    if root.startswith("file:"):
        sizes = {row["hub_id"]: row["n"] for row in _written(bundles, root.removeprefix("file:")).groupBy("hub_id").agg(F.sum("n").alias("n")).collect()}
    else:
        for row in bundles.toLocalIterator():
            files.create(f"{at}/{row['path']}", bytes(row["content"]))
            sizes[row["hub_id"]] = sizes.get(row["hub_id"], 0) + row["n"]
    for hub, size in sizes.items():
        files.create(f"{at}/hub{hub}/log/checkpoint", f"hub{hub}\n{size}\nroot\n")
    listing = {"version": 1, "network": "testnet", "hubs": [{"hub_id": hub, "url": f"{at}/hub{hub}", "active": True} for hub in sorted(sizes)]}
    files.create(f"{at}/hubs.json", json.dumps(listing))
    return f"{at}/hubs.json"
