"""Queries over the driver's tables, one an operator or search path, each with its DuckDB SQL.

Keys name the inventory's operators. Scores are rounded, as sums may differ in their last bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.catalog import Catalog
from simloom.functions import codec
from simloom.model import Options
from simloom.operators import match, score, search, upsert
from simloom.plans import fixtures as fx
from simloom.sources import assets as asset_sources
from simloom.sources import tlog
from simloom.store import shared_dir
from simloom.streaming import ingest
from simloom.streaming.hubs import Poller

#: Sign-bit codes of these vectors seldom reach the default threshold.
OPTIONS = Options(threshold_units=0.65, threshold_simprints=0.65, limit=20)
QUERIES: dict = {}
WITH_UNITS = f"with {fx.UNITS_SQL}"
WITH_SEGMENTS = f"with {fx.UNITS_SQL}, {fx.SEGMENTS_SQL}"


def query(name: str, sql: str | None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function

    return add


def _micro(column):
    return F.round(column * 1_000_000).cast("long")


# ---- codec --------------------------------------------------------------------------------------


@query(
    "c1_base32_codec",
    f"""with d as (select doc_id, n, '40' || printf('%02x', (n // 32 - 1)) || substr(sha256(text), 1, (n // 4)::int) as h
  from (select *, (doc_id % 4 + 1) * 64 as n from documents where text is not null))
select doc_id, 'ISCC:' || {fx.base32_sql("h")} as code, h as digest, 4 as main_type, 0 as sub_type, 0 as version, n::int as nbits,
  'INSTANCE_NONE_V0' as unit_type, substr(h, 5) as body from d""",
)
def c1_base32_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 4 + 1) * 64
    rows = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", n.alias("n"), F.sha2("text", 256).alias("h"))
    digest = F.concat(codec.header(codec.INSTANCE, 0, 0, F.col("n") / 32 - 1), F.unhex(F.substring(F.col("h"), F.lit(1), (F.col("n") / 4).cast("int"))))
    rows = rows.select("doc_id", codec.canonical(digest).alias("code")).withColumn("d", codec.decode_base32(F.col("code")))
    return rows.select(
        "doc_id",
        "code",
        F.lower(F.hex("d")).alias("digest"),
        codec.main_type(F.col("d")).alias("main_type"),
        codec.subtype(F.col("d")).alias("sub_type"),
        codec.version(F.col("d")).alias("version"),
        codec.nbits(F.col("d")).alias("nbits"),
        codec.unit_type(F.col("d")).alias("unit_type"),
        F.lower(F.hex(codec.body(F.col("d")))).alias("body"),
    )


@query(
    "c7_compose_decompose",
    """with d as (select doc_id, md5('m' || text) as m, md5('c' || text) as c, sha256(text) as h, doc_id % 4 as k from documents where text is not null)
select doc_id, case k when 0 then '5700' || substr(h, 1, 64) when 1 then '5101' || substr(c, 1, 16) || substr(h, 1, 16) || substr(h, 33, 16)
    when 2 then '5005' || substr(m, 1, 16) || substr(c, 1, 16) || substr(h, 1, 16) || substr(h, 33, 16) else null end as code,
  case k when 0 then '3003' || substr(h, 1, 32) || ',4003' || substr(h, 33, 32) when 1 then '2101' || substr(c, 1, 16) || ',3001' || substr(h, 1, 16) || ',4001' || substr(h, 33, 16)
    when 2 then '0001' || substr(m, 1, 16) || ',2001' || substr(c, 1, 16) || ',3001' || substr(h, 1, 16) || ',4001' || substr(h, 33, 16) else '' end as units,
  case k when 0 then '3003' || substr(h, 1, 32) || ',4003' || substr(h, 33, 32) when 1 then '2101' || substr(c, 1, 16) || ',3003' || substr(h, 1, 32) || ',4003' || substr(h, 33, 32)
    when 2 then '0001' || substr(m, 1, 16) || ',2001' || substr(c, 1, 16) || ',3003' || substr(h, 1, 32) || ',4003' || substr(h, 33, 32) else '3003' || substr(h, 1, 32) end as sequence
from (select doc_id, m, c, h, k from d)""",
)
def c7_compose_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite codes from units (null without an instance unit), back to units, and a plain sequence split."""
    d = fx.table(spark, sf_dir, "documents").filter("text is not null")
    h, k = F.sha2("text", 256), F.col("doc_id") % 4
    meta = F.concat(codec.header(codec.META, 0, 0, 1), F.unhex(F.substring(F.md5(F.concat(F.lit("m"), "text")), 1, 16)))
    content = F.concat(codec.header(codec.CONTENT, F.when(k == 1, 1).otherwise(0), 0, 1), F.unhex(F.substring(F.md5(F.concat(F.lit("c"), "text")), 1, 16)))
    data = F.concat(codec.header(codec.DATA, 0, 0, 3), F.unhex(F.substring(h, 1, 32)))
    instance = F.concat(codec.header(codec.INSTANCE, 0, 0, 3), F.unhex(F.substring(h, 33, 32)))
    units = F.array_compact(F.array(F.when(k == 2, meta), F.when(k.isin(1, 2), content), data, F.when(k != 3, instance)))
    d = d.select("doc_id", units.alias("u")).withColumn("code", codec.compose(F.col("u")))

    def hexed(column):
        return F.array_join(F.transform(column, lambda x: F.lower(F.hex(x))), ",")

    joined = F.unhex(F.array_join(F.transform("u", F.hex), ""))
    return d.select("doc_id", F.lower(F.hex("code")).alias("code"), hexed(codec.decompose(F.col("code"))).alias("units"), hexed(codec.decompose(joined)).alias("sequence"))


@query(
    "c10_ids",
    f"""with o as (select o_orderkey, o_orderkey % 2 as realm, ((o_orderkey + 77) << 12) as key, o_orderkey % 6 as k from orders),
h as (select *, '6' || realm || '10' || lower(lpad(to_hex(key), 16, '0')) as h from o),
i as (select *, 'ISCC:' || {fx.base32_sql("h")} as id from h)
select o_orderkey, case k when 1 then substr(id, 6) when 2 then replace(id, ':M', ':1') when 3 then substr(id, 1, 13) else id end as iscc_id, key as asset_key, realm::int as realm,
  case k when 1 then 'no_prefix' when 2 then 'bad_base32' when 3 then 'bad_length' else case when realm <> 0 then 'wrong_realm' end end as error from i""",
)
def c10_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from keys, their keys and realms back, and the validation of broken ones (realm 0 is asked for)."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k"), codec.id_from_key(codec.new_id_keys(77, F.col("o_orderkey")), F.col("o_orderkey") % 2).alias("id"))
    k, good = F.col("k"), F.col("id")
    broken = F.when(k == 1, F.substring("id", 6, 99)).when(k == 2, F.replace(good, F.lit(":M"), F.lit(":1"))).when(k == 3, F.substring("id", 1, 13)).otherwise(good)
    return o.select("o_orderkey", broken.alias("iscc_id"), codec.id_key(good).alias("asset_key"), codec.id_realm(good).alias("realm"), codec.id_error(broken, 0).alias("error"))


def _signed_sql(i: int) -> str:
    """Word i of the hex string h as a signed number."""
    word = f"('0x' || substr(h, {1 + 16 * i}, 16))::ubigint::hugeint"
    return f"(case when {word} > 9223372036854775807 then {word} - 18446744073709551616 else {word} end)::bigint"


@query(
    "c13_code_words",
    "with d as (select doc_id, rpad(substr(sha256(text), 1, ((doc_id % 4 + 1) * 16)::int), 64, '0') as h from documents where text is not null) "
    f"select doc_id, {', '.join(f'{_signed_sql(i)} as w{i}' for i in range(4))} from d",
)
def c13_code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of 64 to 256 bits as four signed words."""
    return fx.instance_units(spark, sf_dir).filter("body is not null").select(F.col("asset_key").alias("doc_id"), "w0", "w1", "w2", "w3")


@query(
    "c14_chunk_pointers",
    """select o_orderkey, case when o_orderkey % 9 <> 0 then lower(lpad(to_hex(o_orderkey), 16, '0') || lpad(to_hex(o_custkey), 8, '0') || lpad(to_hex(o_orderkey % 97), 8, '0')) end as pointer,
  case when o_orderkey % 9 <> 0 then o_orderkey end as asset_key, case when o_orderkey % 9 <> 0 then o_custkey end as chunk_offset, case when o_orderkey % 9 <> 0 then o_orderkey % 97 end as chunk_size from orders""",
)
def c14_chunk_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    offset = F.when(F.col("o_orderkey") % 9 == 0, F.lit(2**32)).otherwise(F.col("o_custkey"))
    o = o.select("o_orderkey", codec.pack_pointer(F.col("o_orderkey"), offset, F.col("o_orderkey") % 97).alias("p")).withColumn("u", codec.unpack_pointer(F.col("p")))
    return o.select("o_orderkey", F.lower(F.hex("p")).alias("pointer"), "u.asset_key", F.col("u.offset").alias("chunk_offset"), F.col("u.size").alias("chunk_size"))


@query(
    "c15_simprint_text",
    "select doc_id, translate(rtrim(base64(unhex(md5(text))), '='), '+/', '-_') as simprint, md5(text) as bytes from documents where text is not null",
)
def c15_simprint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", codec.encode_simprint(F.unhex(F.md5("text"))).alias("simprint"))
    return d.select("doc_id", "simprint", F.lower(F.hex(codec.decode_simprint(F.col("simprint")))).alias("bytes"))


@query(
    "c16_features",
    """with d as (select doc_id, lang, md5(text) as h, doc_id % 3 as k from documents where text is not null),
f as (select doc_id, i, case when i < 2 then 'CONTENT_TEXT_V0' else 'SEMANTIC_IMAGE_V1' end as sp_type, case i when 0 then h when 1 then md5(h) when 2 then substr(h, 1, 16) end as b,
  case i when 0 then 0 when 1 then 10 else 7 end as o, case i when 0 then 10 when 1 then 20 else 3 end as z from d, range(3) r(i) where i < 2 or k = 1)
select doc_id, sp_type, translate(rtrim(base64(unhex(substr(b, 1, 16))), '='), '+/', '-_') as simprint, o::bigint as chunk_offset, z::bigint as chunk_size from f""",
)
def c16_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features cut to 64 bits: lists of unequal length, a nameless type, a short and a broken simprint fall away."""
    h = F.md5("text")
    code = lambda x: codec.encode_simprint(F.unhex(x))
    feature = lambda main, sub, vers, sps, offs, sizes: F.struct(F.lit(main).alias("maintype"), F.lit(sub).alias("subtype"), F.lit(vers).alias("version"), sps.alias("simprints"), F.array(*map(F.lit, offs)).alias("offsets"), F.array(*map(F.lit, sizes)).alias("sizes"))
    features = F.array(
        feature("content", "text", 0, F.array(code(h), code(F.md5(h)), code(h)), [0, 10, 30], [10, 20]),
        feature("", "text", 0, F.array(code(h)), [0], [1]),
        feature("semantic", "image", 1, F.array(F.when(F.col("doc_id") % 3 == 1, code(F.substring(h, 1, 16))).when(F.col("doc_id") % 3 == 2, code(F.substring(h, 1, 8))).otherwise(F.lit("!"))), [7], [3]),
    )
    d = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(codec.simprints_of_features(features, 64)).alias("s"))
    return d.select("doc_id", "s.sp_type", "s.simprint", F.col("s.offset").alias("chunk_offset"), F.col("s.size").alias("chunk_size"))


@query(
    "c17_gateways",
    """select event_id, case event_id % 4 when 0 then 'https://g.example/maigabc/x' when 1 then 'https://maigabc.g.example/kecd' when 2 then 'https://g.example' || '/' || md5(props) || '.kecd' else 'https://plain.example' end as url from events""",
)
def c17_gateways(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    template = F.when(k == 0, "https://g.example/{iscc_id}/x").when(k == 1, "https://{iscc_id}.g.example{/iscc_code}").when(k == 2, "https://g.example{/datahash}{.iscc_code}").otherwise("https://plain.example")
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", codec.expand_gateway(template, F.lit("ISCC:MAIGABC"), F.lit("ISCC:KECD"), F.md5("props")).alias("url"))


@query(
    "c18_index_names",
    """with n as (select p_partkey, case p_partkey % 3 when 0 then 'org/ISCC-' || p_name when 1 then p_brand else 'a/' || p_partkey || '-' || p_type end as repo from part),
m as (select *, regexp_replace(lower(regexp_extract(repo, '([^/]*)$', 1)), '[^a-z0-9]', '', 'g') as x from n),
r as (select p_partkey, repo, substr(case when starts_with(x, 'iscc') and length(x) > 4 then substr(x, 5) else x end, 1, 32) as x from m)
select p_partkey, case when regexp_matches(x, '^[a-z]') then x end as index_name, regexp_full_match(repo, '[a-z][a-z0-9]*') as repo_is_name from r""",
)
def c18_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    repo = F.when(k == 0, F.concat(F.lit("org/ISCC-"), "p_name")).when(k == 1, F.col("p_brand")).otherwise(F.concat(F.lit("a/"), "p_partkey", F.lit("-"), "p_type"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", codec.index_name_of(repo).alias("index_name"), codec.index_name_ok(repo).alias("repo_is_name"))


# ---- candidate joins and search -------------------------------------------------------------------

NEAR_SQL = """
dist as (select q, cu.k, qc.t, least(cu.n, qc.n) as l, bit_count(xor(('0x' || substr(cu.b, 1, 8))::bigint, ('0x' || substr(qc.b, 1, 8))::bigint))
    + case when least(cu.n, qc.n) > 32 then bit_count(xor(('0x' || substr(cu.b, 9, 8))::bigint, ('0x' || substr(qc.b, 9, 8))::bigint)) else 0 end as d from cu, qc),
near as (select q, k, t, 1 - d::double / l as s, row_number() over (partition by q order by 1 - d::double / l desc, k) as r from dist),
inst as (select distinct q, iu.k, qi.t, 1.0::double as s from iu join qi on iu.t = qi.t and (starts_with(iu.b, qi.b) or (starts_with(qi.b, iu.b) and (iu.n = 64 or (iu.n = 128 and qi.n = 256)))))
"""


@query("e4_nphd_nearest", f"{WITH_UNITS}, {NEAR_SQL} select q as query_id, k as asset_key, round(s, 9) as score, r as rank from near where r <= 20")
def e4_nphd_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.nphd_nearest(fx.content_units(spark, sf_dir), fx.query_units(spark, sf_dir), 20)
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("e4_nphd_banded", f"{WITH_UNITS}, {NEAR_SQL} select q as query_id, k as asset_key, round(s, 9) as score, r as rank from near where s >= 0.79 and r <= 20")
def e4_nphd_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest codes through bands, as far as these find all of them."""
    found = match.nphd_nearest(fx.content_units(spark, sf_dir), fx.query_units(spark, sf_dir), 20, nearest="banded").filter("score >= 0.79")
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("e3_instance_prefix", f"{WITH_UNITS}, {NEAR_SQL} select q as query_id, k as asset_key, s as score from inst")
def e3_instance_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.prefix_join_binary(fx.units(spark, sf_dir), fx.query_units(spark, sf_dir)).select("query_id", "asset_key", "score")


PREFIX_SQL = """
qu as (select * from qc where n = 64 union all select * from qi), su as (select * from cu where n = 64 union all select * from iu),
pre as (select q, su.k, qu.t, qu.n as qn, max(least(su.n, qu.n)) as bits from su join qu on su.t = qu.t and (starts_with(su.b, qu.b) or starts_with(qu.b, su.b)) group by all),
cnt as (select q, count(*) as c from qu group by q)
"""


@query("e2_prefix_graded", f"{WITH_UNITS}, {PREFIX_SQL} select q as query_id, k as asset_key, t as unit_type, bits::int as matched_bits from pre")
def e2_prefix_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.prefix_join_graded(fx.units(spark, sf_dir).filter("nbits >= 64"), fx.query_units(spark, sf_dir).filter("nbits >= 64"))
    return found.select("query_id", "asset_key", "unit_type", "matched_bits")


@query(
    "f3_search_prefix",
    f"""{WITH_UNITS}, {PREFIX_SQL}, sc as (select pre.q, k, sum(bits::double / qn) / any_value(c) as s from pre join cnt using (q) where k <> pre.q group by pre.q, k)
select query_id, asset_key, round(s, 9) as score, rank from (select q as query_id, k as asset_key, s, row_number() over (partition by q order by round(s, 9) desc, k) as rank from sc) where rank <= 20""",
)
def f3_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.query_units(spark, sf_dir).filter("nbits >= 64")
    own = asked.select("query_id", F.col("query_id").alias("self_key")).distinct()
    found = search.search_prefix(fx.units(spark, sf_dir).filter("nbits >= 64"), asked, own, OPTIONS)
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "search_similarity",
    f"""{WITH_UNITS}, {NEAR_SQL}, c as (select q, k, t, s from near where r <= 20 union all select q, k, t, s from inst),
m as (select q, k, t, max(s) as s from c group by q, k, t),
f as (select q, k, sum(case when s >= 0.65 then pow(s, 4) end) / sum(case when s >= 0.65 then s end) as score, count(*) filter (where s >= 0.65) as n,
  string_agg(t || ':' || round(s * 1000000)::bigint, ',' order by t) as types from m group by q, k),
r as (select *, row_number() over (partition by q order by round(score, 9) desc, k) as rank from f where n > 0 and k <> q)
select q as query_id, k as asset_key, round(score, 9) as score, types, rank from r where rank <= 20""",
)
def search_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production path over two unit types, by stored assets, themselves left out."""
    asked = fx.query_units(spark, sf_dir)
    own = asked.select("query_id", F.col("query_id").alias("self_key")).distinct()
    found = search.search_similarity(fx.units(spark, sf_dir), asked, own, OPTIONS)
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit(":"), _micro(e["value"]).cast("string"))), ",")
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), types.alias("types"), F.col("rank").cast("long").alias("rank"))


@query(
    "e1_search_exact",
    """with a as (select doc_id, sha256(text) as h, lang, source from documents where text is not null),
m as (select q.doc_id as q, a.doc_id as k, a.lang, a.source, row_number() over (partition by q.doc_id order by a.doc_id) as rank from a join a q on a.h = q.h where q.doc_id % 20 = 0 and q.doc_id <> a.doc_id)
select q as query_id, ((k + 1000000) << 12) as asset_key, 1.0::double as score, rank, '{"lang":"' || lang || '","source":"' || source || '"}' as metadata from m where rank <= 20""",
)
def e1_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by id against composite codes, with metadata looked up after the top-k."""
    stored = fx.assets(spark, sf_dir).filter("iscc_code is not null")
    asked = fx.table(spark, sf_dir, "documents").filter((F.col("doc_id") % fx.EVERY == 0) & F.col("text").isNotNull())
    asked = asked.select(F.col("doc_id").alias("query_id"), fx.ids(F.col("doc_id")).alias("iscc_id"), F.lit(None).cast("string").alias("iscc_code"), F.lit(None).cast("array<string>").alias("units"))
    found = search.search(stored, fx.units(spark, sf_dir), asked, OPTIONS.override(mode="exact"))
    return found.select("query_id", "asset_key", "score", F.col("rank").cast("long").alias("rank"), "metadata")


@query(
    "e8_query_by_id",
    f"""with a as (select doc_id, sha256(text) as h from documents where text is not null and doc_id % 20 = 0),
c as (select doc_id, '3003' || substr(h, 1, 32) as d, '4003' || substr(h, 33, 32) as i, '5700' || h as c from a),
s as (select doc_id, 'ISCC:' || {fx.base32_sql("d")} as d, 'ISCC:' || {fx.base32_sql("i")} as i, 'ISCC:' || {fx.base32_sql("c")} as c from c)
select doc_id as query_id, case when doc_id % 3 <> 2 or doc_id % 7 = 0 then c end as iscc_code, case when doc_id % 3 <> 2 or doc_id % 7 = 0 then d || ',' || i end as units,
  doc_id % 3 = 2 and doc_id % 7 <> 0 as not_found, doc_id % 3 <> 2 or doc_id % 7 = 0 as valid from s""",
)
def e8_query_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion by id and normalisation: by code, by units, by a known id and by an unknown one."""
    stored = fx.assets(spark, sf_dir).filter("iscc_code is not null")
    own = stored.withColumn("doc_id", F.shiftright("asset_key", 12) - 1_000_000).filter(F.col("doc_id") % 20 == 0)
    k = F.col("doc_id") % 3
    id_ = F.when((k == 2) & (F.col("doc_id") % 7 == 0), F.col("iscc_id")).when(k == 2, codec.id_from_key(F.col("doc_id"), 1))
    asked = own.select(F.col("doc_id").alias("query_id"), id_.alias("iscc_id"), F.when(k == 0, F.col("iscc_code")).alias("iscc_code"), F.when(k == 1, F.col("units")).alias("units"))
    done = search.normalise(search.expand_by_id(asked, stored))
    return done.select("query_id", "iscc_code", F.concat_ws(",", "units").alias("u"), "not_found", "valid").select("query_id", "iscc_code", F.when(F.col("u") != "", F.col("u")).alias("units"), "not_found", "valid")


@query(
    "a14_point_lookup",
    """with d as (select doc_id, lang, source, doc_id % 3 as k from documents where doc_id % 20 = 0)
select doc_id, case k when 1 then 'no_prefix' when 2 then 'not_found' end as error, case when k = 0 then '{"lang":"' || lang || '","source":"' || source || '"}' end as metadata from d""",
)
def a14_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    good = fx.ids(F.col("doc_id"))
    asked = fx.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 20 == 0).select("doc_id", F.when(k == 0, good).when(k == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(fx.ids(F.col("doc_id") + 10_000_000)).alias("iscc_id"))
    found = search.get_assets(fx.assets(spark, sf_dir), asked)
    return asked.join(found.withColumnRenamed("iscc_id", "asked"), F.col("iscc_id") == F.col("asked")).select("doc_id", "error", F.when(F.col("error").isNull(), F.col("metadata")).alias("metadata"))


# ---- segments ---------------------------------------------------------------------------------------

EXACT_SQL = """
hit as (select q, p, ts.t, ts.s, ts.k, o, z, row_number() over (partition by q, ts.s order by ts.k, o, z) as r from ts join qts using (t, s)),
hits as (select * from hit where r <= 1000),
df as (select q, s, count(distinct k) as f from hits group by q, s),
per as (select q, k, s, any_value(f) as f, count(*) as n from hits join df using (q, s) group by q, k, s),
nq as (select q, count(*) as n_q from qts group by q),
agg as (select q, k, count(*) as found, sum(n) as matches, avg(1.0::double / f) as m, min(1.0::double / f) as lo, max(1.0::double / f) as hi from per group by q, k),
sc as (select q, k, matches, n_q, found::double / n_q * case when lo = hi then 1 else (m - lo) / (hi - lo) end as s from agg join nq using (q))
"""


@query("e6_segment_exact", f"{WITH_SEGMENTS}, {EXACT_SQL} select q as query_id, p as sp_pos, k as asset_key, o as chunk_offset, z as chunk_size from hits")
def e6_segment_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.text_segments(spark, sf_dir)
    found = match.segment_exact(segments, fx.query_segments(segments))
    return found.select("query_id", "sp_pos", "asset_key", F.col("offset").alias("chunk_offset"), F.col("size").alias("chunk_size"))


@query(
    "f9_search_segments_exact",
    f"""{WITH_SEGMENTS}, {EXACT_SQL}, ok as (select *, row_number() over (partition by q order by round(s, 9) desc, k) as r from sc where round(s, 9) >= 0.65)
select q as query_id, k as asset_key, round(s, 9) as score, matches::bigint as matches, n_q as queried, r as rank from ok where r <= 20""",
)
def f9_search_segments_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.text_segments(spark, sf_dir)
    found = search.search_segments(segments, fx.query_segments(segments), 0, exact=True, options=OPTIONS, chunks=False)
    detail = F.map_values("types")[0]
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), detail["matches"].alias("matches"), detail["queried"].alias("queried"), F.col("rank").cast("long").alias("rank"))


@query(
    "f12_chunk_details",
    f"{WITH_SEGMENTS}, {EXACT_SQL} select q as query_id, k as asset_key, s as sp, f as freq, o as chunk_offset, z as chunk_size, 1.0::double as score from hits join df using (q, s)",
)
def f12_chunk_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched segments behind each result of the exact segment search, with their frequencies."""
    segments = fx.text_segments(spark, sf_dir)
    asked = fx.query_segments(segments)
    found = score.coverage_quality(match.segment_exact(segments, asked), asked, 0.0).select("query_id", "asset_key", F.explode("chunks").alias("c"))
    return found.select("query_id", "asset_key", F.lower(F.hex("c.match")).alias("sp"), "c.freq", F.col("c.offset").alias("chunk_offset"), F.col("c.size").alias("chunk_size"), "c.score")


NEAREST_SEGMENTS_SQL = """
pair as (select q, p, qvs.s as qs, vs.k, vs.s, o, z, 1 - (bit_count(xor(('0x' || substr(vs.s, 1, 8))::bigint, ('0x' || substr(qvs.s, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(vs.s, 9, 8))::bigint, ('0x' || substr(qvs.s, 9, 8))::bigint)))::double / 64 as sim from vs, qvs),
ranked as (select *, row_number() over (partition by q, qs order by sim desc, k, o, z) as r from pair)
"""


@query("e5_segment_nearest", f"{WITH_SEGMENTS}, {NEAREST_SEGMENTS_SQL} select q as query_id, qs as q_sp, k as asset_key, o as chunk_offset, round(sim, 9) as score, r as rank from ranked where r <= 40")
def e5_segment_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.vector_segments(spark, sf_dir)
    found = match.segment_nearest(segments, fx.query_segments(segments), limit=5, oversampling=4)
    return found.select("query_id", F.lower(F.hex("q_sp")).alias("q_sp"), "asset_key", F.col("offset").alias("chunk_offset"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("e5_segment_banded", f"{WITH_SEGMENTS}, {NEAREST_SEGMENTS_SQL} select q as query_id, qs as q_sp, k as asset_key, o as chunk_offset, round(sim, 9) as score, r as rank from ranked where r <= 40 and sim >= 0.79")
def e5_segment_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest segments through bands, as far as these find all of them."""
    segments = fx.vector_segments(spark, sf_dir)
    found = match.segment_nearest(segments, fx.query_segments(segments), limit=5, oversampling=4, nearest="banded").filter("score >= 0.79")
    return found.select("query_id", F.lower(F.hex("q_sp")).alias("q_sp"), "asset_key", F.col("offset").alias("chunk_offset"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "f8_search_segments_approx",
    f"""{WITH_SEGMENTS}, {NEAREST_SEGMENTS_SQL},
n as (select count(distinct k)::double as n from vs),
df as (select s, count(distinct k) as f from (select *, row_number() over (partition by s order by k, o, z) as r from vs) where r <= 1000 group by s),
best as (select * from (select *, row_number() over (partition by q, qs, k order by sim desc, o, z) as b from ranked where r <= 800 and sim >= 0.65) where b = 1),
qidf as (select q, qs, ln(1 + n / (1 + coalesce(f, 0))) as idf from (select q, s as qs from qvs) cross join n left join df on df.s = qs),
tot as (select q, sum(idf) as total, count(*) as queried from qidf group by q),
w as (select best.q, best.k, sim, ln(1 + n / (1 + f)) as mi, qidf.idf as own from best cross join n join df on df.s = best.s join qidf on qidf.q = best.q and qidf.qs = best.qs),
sc as (select w.q, k, sum(mi * sim) / (any_value(total) + sum(mi - own)) as s, count(*) as matches, any_value(queried) as queried from w join tot on tot.q = w.q group by w.q, k),
rk as (select *, row_number() over (partition by q order by round(s, 9) desc, k) as rank from sc)
select q as query_id, k as asset_key, round(s, 9) as score, matches, queried, rank from rk where rank <= 20""",
)
def f8_search_segments_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.vector_segments(spark, sf_dir)
    total = segments.select("asset_key").distinct().count()
    found = search.search_segments(segments, fx.query_segments(segments), total, options=OPTIONS, chunks=False)
    detail = F.map_values("types")[0]
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), detail["matches"].alias("matches"), detail["queried"].alias("queried"), F.col("rank").cast("long").alias("rank"))


def _index(spark: SparkSession, name: str, options: Options = OPTIONS):
    """A new index in the shared folder."""
    return Catalog(spark, f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}", options).create(name)


@query(
    "f11_index_segments",
    f"""with {fx.exact_of_type_sql("a", fx.WINDOW, fx.SEGMENT_TYPE)}, {fx.exact_of_type_sql("b", 2 * fx.WINDOW, fx.VECTOR_TYPE)},
both_ as (select q, k, t, s, matches, n_q from a_top union all select q, k, t, s, matches, n_q from b_top),
m as (select q, k, avg(s) as score, string_agg(t || ':' || round(s * 1000000)::bigint || ':' || matches || ':' || n_q || ':' || matches, ',' order by t) as types from both_ group by q, k),
r as (select *, row_number() over (partition by q order by round(score, 9) desc, k) as rank from m)
select q as query_id, ((k + 1000000) << 12) as asset_key, round(score, 9) as score, types, rank, d.source from r join documents d on d.doc_id = k where rank <= 20""",
)
def f11_index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segment types stored in an index and searched there: the mean over types, twice the limit a type, chunks and source."""
    index = _index(spark, "segments")
    index.upsert(fx.index_entries(spark, sf_dir))
    found = index.search_segments(fx.segment_questions(spark, sf_dir), exact=True)
    parts = (lambda d: (_micro(d["score"]), d["matches"], d["queried"], F.size(d["chunks"])))
    types = F.array_join(F.transform(F.sort_array(F.map_entries("types")), lambda e: F.concat_ws(":", e["key"], *(p.cast("string") for p in parts(e["value"])))), ",")
    return found.select("query_id", "asset_key", F.round("score", 9).alias("score"), types.alias("types"), F.col("rank").cast("long").alias("rank"), "source")


@query(
    "f16_index_stats",
    f"""with d as (select doc_id, string_split(text, ' ') as w from documents where text is not null),
s as (select '{fx.SEGMENT_TYPE}' as name, doc_id, md5(array_to_string(list_slice(w, o + 1, o + {fx.WINDOW}), ' ')) as h, o from (select *, unnest(range(0, len(w), {fx.WINDOW})) as o from d)
  union all select '{fx.VECTOR_TYPE}', doc_id, md5(array_to_string(list_slice(w, o + 1, o + {2 * fx.WINDOW}), ' ')), o from (select *, unnest(range(0, len(w), {2 * fx.WINDOW})) as o from d))
select 'segments' as what, name, count(*) as n from s group by name union all select 'bits', name, 64 from s group by name
union all select 'units', x, (select count(*) from d) from (values ('DATA_NONE_V0'), ('INSTANCE_NONE_V0')) v(x) union all select 'assets', '', (select count(*) from d)""",
)
def f16_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index counts of itself: assets, unit types, segment types and their bits."""
    index = _index(spark, "stats")
    index.upsert(fx.index_entries(spark, sf_dir))
    stats = index.stats()
    rows = [("assets", "", stats["assets"])]
    for what, key in (("units", "types"), ("segments", "segment_types"), ("bits", "segment_bits")):
        rows += [(what, name, n) for name, n in stats[key].items()]
    return spark.createDataFrame(rows, "what string, name string, n long")


@query(
    "b3_index_replays",
    """with n as (select count(*) as n from documents where text is not null)
select 'first' as batch, 1::bigint as generations, true as wrote, n as created, 0::bigint as updated from n union all select 'replay', 0, false, 0, n from n
union all select 'one asset', 1, true, 0, 1""",
)
def b3_index_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch, the same batch again, which writes nothing, and a change of one asset, which rewrites its bucket alone."""
    index = _index(spark, "replays")
    entries = fx.index_entries(spark, sf_dir)
    one = entries.orderBy("pos").limit(1).withColumn("metadata", F.lit("{}"))
    rows = []
    for name, batch in (("first", entries), ("replay", entries), ("one asset", one)):
        before = index.manifest()
        summary = upsert.summary(index.upsert(batch)).first()
        after = index.manifest()
        moved = {b for t in after["tables"] for b, f in after["tables"][t].items() if before["tables"][t].get(b) != f}
        wrote = bool(moved) if name != "one asset" else len(moved) == 1
        rows.append((name, after["generation"] - before["generation"], wrote, summary["created"], summary["updated"]))
    return spark.createDataFrame(rows, "batch string, generations long, wrote boolean, created long, updated long")


@query("f6_document_frequency", f"{WITH_SEGMENTS} select s as sp, count(distinct k) as freq from (select *, row_number() over (partition by s order by k, o, z) as r from ts) where r <= 1000 group by s")
def f6_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.document_frequency(fx.text_segments(spark, sf_dir)).select(F.lower(F.hex("sp")).alias("sp"), "freq")


@query("a16_segments_of_assets", f"{WITH_SEGMENTS} select distinct k as asset_key, s as sp, o as chunk_offset, z as chunk_size from ts where k % 20 = 0")
def a16_segments_of_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of one type that an index holds of every twentieth asset."""
    index = _index(spark, "segments")
    index.upsert(fx.index_entries(spark, sf_dir))
    asked = fx.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 20 == 0).select(fx.ids(F.col("doc_id")).alias("iscc_id"))
    own = index.segments(asked).filter(F.col("sp_type") == fx.SEGMENT_TYPE)
    key = F.shiftright("asset_key", 12) - 1_000_000
    return own.select(key.alias("asset_key"), F.lower(F.hex("sp")).alias("sp"), F.col("offset").alias("chunk_offset"), F.col("size").alias("chunk_size"))


@query("f17_segment_bits", f"{WITH_SEGMENTS} select t as sp_type, max(length(s) * 4)::int as bits, count(*) as segments from (select t, s from ts union all select t, s from vs) group by t")
def f17_segment_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.text_segments(spark, sf_dir).unionByName(fx.vector_segments(spark, sf_dir))
    return both.groupBy("sp_type").agg(F.max(F.octet_length("sp") * 8).alias("bits"), F.count("*").alias("segments"))


# ---- upserts ------------------------------------------------------------------------------------------

#: Users with an id below the median of events are stored before; the batch is the later half of events.
BATCH_SQL = "b as (select event_id as pos, user_id as k, event_type as v from events where event_id >= (select count(*) // 2 from events)), st as (select user_id as k, arg_max(event_type, event_id) as v from events where event_id < (select count(*) // 2 from events) group by user_id)"


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = fx.table(spark, sf_dir, "events")
    half = events.count() // 2
    rows = events.select(F.col("event_id").alias("pos"), F.col("user_id").alias("asset_key"), F.col("event_type").alias("metadata"))
    return rows.filter(F.col("pos") >= half), upsert.last_of_batch(rows.filter(F.col("pos") < half)).drop("pos")


@query(
    "b1_upsert_statuses",
    f"with {BATCH_SQL} select pos, b.k as asset_key, case when row_number() over (partition by b.k order by pos) = 1 and st.k is null then 'created' else 'updated' end as status from b left join st using (k)",
)
def b1_upsert_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.statuses(*_batch(spark, sf_dir))


@query("b2_upsert_state", f"with {BATCH_SQL}, w as (select k, arg_max(v, pos) as v from b group by k) select k as asset_key, v as metadata from w union all select k, v from st where k not in (select k from w)")
def b2_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stored = _batch(spark, sf_dir)
    return upsert.replace_keys(stored, upsert.last_of_batch(batch).drop("pos"), ("asset_key",))


@query("b3_upsert_changed", f"with {BATCH_SQL}, w as (select k, arg_max(v, pos) as v from b group by k) select w.k as asset_key, w.v as metadata from w left join st using (k) where st.k is null or w.v is distinct from st.v")
def b3_upsert_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stored = _batch(spark, sf_dir)
    return upsert.changed(upsert.last_of_batch(batch), stored, ("metadata",)).select("asset_key", "metadata")


@query(
    "b14_upsert_summary",
    f"with {BATCH_SQL}, s as (select case when row_number() over (partition by b.k order by pos) = 1 and st.k is null then 1 else 0 end as c from b left join st using (k)) select count(*) as added, sum(c)::bigint as created, (count(*) - sum(c))::bigint as updated, 0::bigint as errors from s",
)
def b14_upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.summary(upsert.statuses(*_batch(spark, sf_dir)))


@query(
    "b4_segment_fingerprints",
    f"{WITH_SEGMENTS} select k as asset_key, sha256(string_agg(x, '|' order by x)) as fingerprint from (select k, upper(s) || ':' || o || ':' || z as x from ts) group by k",
)
def b4_segment_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.fingerprint(fx.text_segments(spark, sf_dir)).select("asset_key", "fingerprint")


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an update of every fifth asset: instance units of the next asset's text."""
    later = fx.instance_units(spark, sf_dir)
    return later.filter(F.col("asset_key") % 5 == 1).withColumn("asset_key", F.col("asset_key") - 1)


@query(
    "b6_stale_instances",
    f"{WITH_UNITS}, u as (select k - 1 as k, t, b from iu where k % 5 = 1) select iu.k as asset_key, iu.b as body from iu where iu.k in (select k from u) and (iu.k, iu.b) not in (select (k, b) from u)",
)
def b6_stale_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ("asset_key", "unit_type", "body")
    return upsert.stale_instances(fx.units(spark, sf_dir).select(*c), _revised(spark, sf_dir).select(*c)).select("asset_key", F.lower(F.hex("body")).alias("body"))


@query(
    "b8_replace_units",
    f"{WITH_UNITS}, u as (select k - 1 as k, t, n, b from iu where k % 5 = 1), o as (select * from cu union all select * from iu) select k as asset_key, t as unit_type, n::int as nbits, b as body from o where (k, t) not in (select (k, t) from u) union all select k, t, n::int, b from u",
)
def b8_replace_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = upsert.replace_keys(fx.units(spark, sf_dir), _revised(spark, sf_dir), ("asset_key", "unit_type"))
    return new.select("asset_key", "unit_type", "nbits", F.lower(F.hex("body")).alias("body"))


@query(
    "b9_append_units",
    f"{WITH_UNITS}, o as (select k, t, b from iu union all select k - 1, t, b from iu where k % 5 = 1) select distinct k as asset_key, t as unit_type, b as body from o",
)
def b9_append_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.append_units(fx.instance_units(spark, sf_dir), _revised(spark, sf_dir)).select("asset_key", "unit_type", F.lower(F.hex("body")).alias("body"))


@query(
    "b7_replace_segments",
    f"{WITH_SEGMENTS}, n as (select k - 1 as k, t, s, o, z from ts where k % 5 = 1) select k as asset_key, s as sp, o as chunk_offset from ts where (k, t) not in (select (k, t) from n) union all select k, s, o from n",
)
def b7_replace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.text_segments(spark, sf_dir)
    new = old.filter(F.col("asset_key") % 5 == 1).withColumn("asset_key", F.col("asset_key") - 1)
    return upsert.replace_keys(old, new, ("asset_key", "sp_type")).select("asset_key", F.lower(F.hex("sp")).alias("sp"), F.col("offset").alias("chunk_offset"))


@query(
    "b11_first_per_place",
    "select arg_min(event_id, event_id) as pos, user_id as asset_key, event_id % 3 as chunk_offset from events group by user_id, event_id % 3",
)
def b11_first_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.lit("X").alias("sp_type"), F.col("user_id").alias("asset_key"), (F.col("event_id") % 3).alias("offset"), F.lit(1).alias("size"))
    return upsert.first_per_place(e).select("pos", "asset_key", F.col("offset").alias("chunk_offset"))


@query(
    "b13_entry_json",
    """select doc_id, '{"key":' || doc_id || case when lang = 'en' then ',"source":"' || source || '"' else '' end || ',"units":["' || lang || '"]}' as entry from documents""",
)
def b13_entry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    columns = [F.col("doc_id").alias("key"), F.when(F.col("lang") == "en", F.col("source")).alias("source"), F.array("lang").alias("units")]
    return d.select("doc_id", upsert.entry_json(columns).alias("entry"))


@query(
    "b16_rebuild_longest",
    """with u as (select user_id as k, event_type as t, (event_id % 4 + 1) * 64 as n, event_id as p, md5(event_id::varchar) as b from events)
select k as asset_key, t as unit_type, n::int as nbits, b as body from (select *, row_number() over (partition by k, t order by n desc, p desc) as r from u) where r = 1""",
)
def b16_rebuild_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_key"), F.col("event_type").alias("unit_type"), ((F.col("event_id") % 4 + 1) * 64).cast("int").alias("nbits"), F.col("event_id").alias("unit_pos"), F.md5(F.col("event_id").cast("string")).alias("body"))
    return upsert.longest_units(e).select("asset_key", "unit_type", "nbits", "body")


@query(
    "b17_out_of_sync",
    "with a as (select event_type as t, count(*) as n from events group by 1), b as (select event_type as t, count(*) as n from events where event_type <> 'click' or event_id % 2 = 0 group by 1) select a.t as event_type, a.n as expected, coalesce(b.n, 0) as actual from a left join b using (t) where a.n <> coalesce(b.n, 0)",
)
def b17_out_of_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return upsert.out_of_sync(e, e.filter("event_type <> 'click' or event_id % 2 = 0"), "event_type")


@query("d8_realm_conflicts", "select (user_id % 2)::int as realm, count(*) as n from events group by 1")
def d8_realm_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 2).cast("int").alias("realm"), "event_id")
    return upsert.realm_conflicts(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


@query("f14_index_counts", f"{WITH_UNITS} select t as unit_type, count(*) as units, count(distinct k) as assets from (select k, t from cu union all select k, t from iu) group by t")
def f14_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.units(spark, sf_dir).groupBy("unit_type").agg(F.count("*").alias("units"), F.countDistinct("asset_key").alias("assets"))


@query("e9_membership", "select doc_id as asset_key, doc_id in (select doc_id from labels) as present from documents")
def e9_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents an index of the labelled ones contains."""
    index = _index(spark, "labelled")
    labelled = fx.table(spark, sf_dir, "labels").select(F.shiftleft(F.col("doc_id") + 1_000_000, 12).alias("asset_key"))
    index.upsert(fx.assets(spark, sf_dir).join(labelled, "asset_key", "left_semi").select("iscc_id", "iscc_code", "units", "metadata", F.col("asset_key").alias("pos")))
    found = index.contains(fx.table(spark, sf_dir, "documents").select(fx.ids(F.col("doc_id")).alias("iscc_id")))
    return found.select((F.shiftright("asset_key", 12) - 1_000_000).alias("asset_key"), "present")


# ---- sources and logs -----------------------------------------------------------------------------------


@query(
    "a7_dataset_entries",
    """select case when doc_id % 3 = 0 then 'ISCC:' || upper(md5(text)) end as iscc_code, case when doc_id % 3 <> 2 then 'u' || doc_id || ',v' || doc_id end as units,
  '{"hf_dataset":"org/set","doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' as metadata from documents where text is not null and doc_id % 3 <> 2""",
)
def a7_dataset_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows to entries: column choice, rows without code and units dropped, empty and nested values left out."""
    d = fx.table(spark, sf_dir, "documents").filter("text is not null")
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    rows = d.select(
        "doc_id",
        "lang",
        F.lit("").alias("empty"),
        F.array("lang").alias("nested"),
        "n_chars",
        F.when(k == 0, F.concat(F.lit("ISCC:"), F.upper(F.md5("text")))).otherwise("").alias("iscc"),
        F.concat(F.lit("u"), n).alias("iscc_meta"),
        F.lit(None).cast("string").alias("iscc_semantic"),
        F.lit("").alias("iscc_content"),
        F.when(k != 2, F.concat(F.lit("v"), n)).alias("iscc_data"),
        F.lit(None).cast("string").alias("iscc_instance"),
    )
    keep = [c for c in rows.columns if c.startswith("iscc")] + asset_sources.metadata_columns(rows.schema)
    return asset_sources.entries_of_rows(rows.select(*keep), "org/set").withColumn("units", F.concat_ws(",", "units"))


@query(
    "i1_plan_bundles",
    """with h as (select c_custkey as h, c_custkey * 3 as last, case when c_custkey % 5 = 0 then c_custkey else c_custkey * 3 + c_custkey % 700 end as tree from customer),
s as (select h, case when tree < last then 0 else last end as last, tree from h),
b as (select h, last, tree, unnest(range(last // 256, (tree - 1) // 256 + 1)) as b from s where tree > last),
p as (select h, b, case when (b + 1) * 256 <= tree then 0 else tree - b * 256 end as w, greatest(0, last - b * 256) as skip from b)
select h as hub_id, b as bundle, w as width, skip, 'tile/entries/' || case when b >= 1000 then printf('x%03d/%03d', b // 1000, b % 1000) else printf('%03d', b) end || case when w > 0 then '.p/' || w else '' end as path from p""",
)
def i1_plan_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles to read for hubs whose trees have grown, or shrunk and start again, with their paths."""
    k = F.col("c_custkey")
    last, tree = k * 3, F.when(k % 5 == 0, k).otherwise(k * 3 + k % 700)
    hubs = fx.table(spark, sf_dir, "customer").select(k.alias("hub_id"), tlog.next_cursor(last, tree).alias("last_size"), tree.alias("tree_size"))
    return tlog.plan_bundles(hubs).withColumn("path", tlog.entries_path(F.col("bundle"), F.col("width")))


@query(
    "a11_checkpoints",
    "select c_custkey, case c_custkey % 5 when 0 then null when 1 then null when 2 then null else c_custkey end as tree_size from customer",
)
def a11_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("hub\n0"), n, F.lit("1\nroot\n"))).when(k == 1, F.concat(F.lit("hub\n-"), n, F.lit("\nroot"))).when(k == 2, F.concat(F.lit("hub\n"), n)).otherwise(F.concat(F.lit("hub\n"), n, F.lit("\nroot\n\nsig\n")))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", tlog.tree_size(text).alias("tree_size"))


@query(
    "a12_bundle_records",
    "select event_id % 2 as hub_id, event_id // 2 as leaf_index, md5(event_type || event_id) as record, null::varchar as error from events where (event_id // 2) // 256 <> 1 union all select h, null, null, 'truncated bundle' from range(2) r(h) where (select count(*) from events) > 512",
)
def a12_bundle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed bundles of 256 records back to records; the second bundle of each hub is cut short."""
    e = fx.table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("hub_id"), F.floor(F.col("event_id") / 2).alias("leaf"), F.md5(F.concat("event_type", F.col("event_id").cast("string"))).alias("r"))
    framed = F.concat(F.lit("0020"), F.hex(F.col("r").cast("binary")))
    bundles = e.withColumn("bundle", F.floor(F.col("leaf") / tlog.WIDTH)).groupBy("hub_id", "bundle").agg(F.count("*").alias("expected"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", framed.alias("f")))), lambda x: x["f"]), "").alias("h"))
    cut = F.when(F.col("bundle") == 1, F.substring("h", 1, 101 * 2)).otherwise(F.col("h"))
    found = tlog.records(bundles.select("hub_id", "bundle", "expected", F.lit(0).alias("skip"), F.unhex(cut).alias("content")))
    return found.select("hub_id", "leaf_index", F.col("record").cast("string").alias("record"), "error")


@query(
    "f15_reason_counts",
    """select event_id % 2 as hub_id, count(*) filter (where event_id % 7 in (0, 1, 2)) as ok, count(*) filter (where event_id % 7 = 3) as deletion, count(*) filter (where event_id % 7 = 4) as unknown_schema,
  count(*) filter (where event_id % 7 = 5) as malformed, count(*) filter (where event_id % 7 = 6) as realm_mismatch from events group by 1""",
)
def f15_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reason_counts(ingest.classify(fx.log_records(spark, sf_dir), "testnet"))


@query(
    "i2_followed_state",
    f"""with e as (select event_id, user_id, sha256(event_id::varchar) as h, row_number() over (partition by user_id order by event_id // 2 desc, event_id % 2 desc) as r from events where event_id % 7 in (0, 1, 2)),
x as (select (user_id + 5000) << 12 as k, '5001' || substr(h, 1, 16) || substr(h, 17, 16) || substr(h, 1, 16) as code from e where r = 1)
select k as asset_key, 'ISCC:' || {fx.base32_sql("code")} as iscc_code from x""",
)
def i2_followed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds after the logs of both hubs were polled to their ends: of each asset the record with the greatest place."""
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    poller = Poller(spark, _index(spark, "followed"), fx.log_folders(spark, sf_dir, at), "testnet", f"{at}/state")
    poller.refresh()
    failed = [s for s in poller.catch_up() if not s["ok"]]
    if failed:
        raise RuntimeError(f"hubs failed: {failed}")
    return poller.index.table("assets").select("asset_key", "iscc_code")


@query(
    "c20_log_entries",
    f"""with e as (select *, sha256(event_id::varchar) as h from events where event_id % 7 in (0, 1, 2)),
x as (select event_id, h, '6010' || lower(lpad(to_hex((user_id + 5000) << 12), 16, '0')) as id, '5001' || substr(h, 1, 16) || substr(h, 17, 16) || substr(h, 1, 16) as code,
  '2001' || substr(h, 1, 16) as c, '3003' || substr(h, 17, 32) as d, '4007' || h as i from e)
select event_id, 'ISCC:' || {fx.base32_sql("code")} as iscc_code, 'ISCC:' || {fx.base32_sql("c")} || ',ISCC:' || {fx.base32_sql("d")} || ',ISCC:' || {fx.base32_sql("i")} as units,
  case when event_id % 7 = 1 then '{{"gateway":"https://' || lower({fx.base32_sql("id")}) || '.x/1e20' || h || '"}}' end as metadata from x""",
)
def c20_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations to entries: the longest unit of each type, the data hash's instance unit, the expanded gateway."""
    entries = ingest.classify(fx.log_records(spark, sf_dir), "testnet").filter("reason = 'ok'")
    return entries.select("event_id", "iscc_code", F.concat_ws(",", "units").alias("units"), "metadata")
