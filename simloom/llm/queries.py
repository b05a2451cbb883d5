"""The queries of the operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, mixing, ngram_join, pii, quality, secrets, spotsigs, token_counts
from .common import materialise, sha_hex, table

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha_hex(F.col("items")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


OP1_SQL = rf"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(coalesce({LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(coalesce({LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, least(13, len(w)) as m, list_slice(w, i, i + least(13, len(w)) - 1) as win
      from (select item_id, w, unnest(range(1, greatest(len(w) - least(13, len(w)) + 2, 1))) as i from b where len(w) > 0)),
lens as (select distinct m from p),
dw as (select rid, m, i, list_slice(w, i, i + m - 1) as win
       from (select rid, m, w, unnest(range(1, greatest(len(w) - m + 2, 1))) as i from d, lens)),
hits as (select rid, i, m, item_id from dw join p using (m, win)),
words as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + m)) as k from (select distinct rid, i, m from hits)) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rid, item_id from hits where item_id is not null) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (rid) left join items using (rid)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mix_sql(docs: str) -> str:
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key, text from {docs}),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as w from s),
r as (select *, row_number() over (order by 3 * source_size / w, source is null, source) as pos,
    ((select sum(source_size) from s) - coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0))::bigint as l,
    ((select sum(w) from w) - coalesce(sum(w) over (order by 3 * source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0))::bigint as wl
    from w),
f as (select pos, l, wl from r where (3 * source_size)::hugeint * wl >= l::hugeint * w order by pos limit 1),
t as (select r.source, source_size, case when r.pos < f.pos then (3 * source_size)::double else f.l::double * w / f.wl end as target from r, f),
x as (select doc_id, size, source_size, target, floor(target)::bigint as budget,
    coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - pos)) else 0 end)::bigint as taken
from x
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host; n_lines and n_kept count lines before and after."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", F.col(line_dedup.N_LINES).alias("n_lines"), F.col(line_dedup.N_KEPT).alias("n_kept"), "text")


def line_dedup_sql(docs: str) -> str:
    return f"""
with d as (select *, row_number() over () as rid, string_split(text, chr(10)) as ls from {docs}),
l as (select distinct rid, source, line from (select rid, source, trim(unnest(ls), ' ' || chr(9) || chr(13)) as line from d) where line <> ''),
t as (select source, count(*) as n from d group by source),
b as (select l.source, line from l join t on l.source is not distinct from t.source group by l.source, line, n having count(*) >= 3 and count(*) * 100 > n * 10),
g as (select source, list(line) as drops from b group by source),
k as (select d.*, case when drops is null then ls else list_filter(ls, lambda x: not list_contains(drops, trim(x, ' ' || chr(9) || chr(13)))) end as kept
  from d left join g on d.source is not distinct from g.source)
"""


OP5_SQL = line_dedup_sql("documents") + "select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(kept), 0)::bigint as n_kept, array_to_string(kept, chr(10)) as text from k"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    packs = materialise(chat_format.pack_conversations(chat_format.conversations_of(rows)), "packs")
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return chat_format.read_packs(packs).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha_hex(F.array_join(turn, "")).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        sha_hex(loss).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_sql() -> str:
    out = r"replace({x}, '\', '\\')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP6_SQL = f"""
with r as (select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select conv_id, null, turn, role, text from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
f as (select *, length({_escaped_sql().format(x="text")}) + case role when 'user' then 18 when 'assistant' then 6 when 'system' then 17
    else 18 + length(replace({_escaped_sql().format(x="role")}, chr(10), '\\' || chr(10))) end as chars from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from f group by conv_id, own
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha_hex(F.col("base")).alias("base_sha256"), "spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({LOWER_SQL}, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
x as (select doc_id, g from s where g in (select g from s group by g having count(*) > 1)),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
reach(id, r) as (select doc_id, doc_id from documents union select reach.id, e.b from reach join e on reach.r = e.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents left join n using (doc_id)
  join (select id as doc_id, min(r) as component_id from reach group by id) using (doc_id)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha_hex(F.col("base")).alias("base_sha256"), "spans")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        sha_hex(F.col("edited_text")).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints joined: the class of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs"))
    return spotsigs.near_duplicates(docs)


def _spots_sql() -> str:
    anchors = "[" + ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS.split()))) + "]"
    chain = f"list_slice(list_filter(list_slice(w, i + 1, i + {spotsigs.REACH}), lambda x: not list_contains({anchors}, x)), 1, {spotsigs.CHAIN})"
    return rf"""
with recursive d as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
sp as (select doc_id, w[i] || '|' || array_to_string({chain}, '|') as g from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) where list_contains({anchors}, w[i])),
s as (select distinct doc_id, g from sp union all
  select doc_id, case when len(w) > 0 then 'words ' || array_to_string(w, ' ') else 'text ' || text end from d where text <> '' and doc_id not in (select doc_id from sp)),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select doc_id, md5(string_agg(g, chr(10) order by g)) as f from s group by doc_id),
c as (select f, min(doc_id) as c from f group by f),
m as (select doc_id, c from f join c using (f)),
k as (select doc_id, g from s where doc_id in (select c from c)),
x as (select doc_id, g from k where g in (select g from k group by g having count(*) > 1)),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
reach(id, r) as (select c, c from c union select reach.id, e.b from reach join e on reach.r = e.a)
select d.doc_id, coalesce(n, 0)::bigint as n_signatures, coalesce(r.r, (select min(doc_id) from d where text = '')) as class_id
from d left join n using (doc_id) left join m using (doc_id) left join (select id, min(r) as r from reach group by id) r on r.id = m.c
"""


QUERIES = {
    "op1_decontaminate": (op1_decontaminate, OP1_SQL),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_quality": (op3_quality, None),
    "op4_mixing": (op4_mixing, mix_sql("documents")),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_chat_format": (op6_chat_format, OP6_SQL),
    "op7_ngram_join": (op7_ngram_join, OP7_SQL),
    "op8_token_counts": (op8_token_counts, None),
    "op9_pii": (op9_pii, None),
    "op10_spotsigs": (op10_spotsigs, None),
    "spotsigs_near_duplicates": (spotsigs_near_duplicates, _spots_sql()),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
