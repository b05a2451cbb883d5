"""Scores with known values, search modes, upserts, the catalog, sources and the stream."""

import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from simloom.catalog import Catalog, Conflict
from simloom.functions import codec
from simloom.model import Options
from simloom.operators import match, score, search, upsert
from simloom.plans import fixtures
from simloom.sources import assets as asset_sources
from simloom.sources import tlog
from simloom.streaming import ingest
from simloom.streaming.hubs import Poller


def per_type(spark, scores):
    return spark.createDataFrame([(1, 1, f"T{i}", s) for i, s in enumerate(scores)], "query_id long, asset_key long, unit_type string, score double")


@pytest.mark.parametrize("scores, want", [([0.95], 0.857375), ([1.0, 0.8], 0.783111111), ([0.78, 0.76], 0.456995013), ([1.0, 0.5], 1.0), ([0.75], 0.421875)])
def test_confidence(spark, scores, want):
    row = score.confidence(per_type(spark, scores)).first()
    assert row.score == pytest.approx(want, abs=1e-9)
    assert len(row.types) == len(scores)


def test_confidence_needs_a_type_at_the_threshold(spark):
    assert score.confidence(per_type(spark, [0.7, 0.74])).isEmpty()


@pytest.mark.parametrize("freq, total, want", [(42, 1000.0, 3.188656339), (1, 0.0, 0.0), (0, 10.0, math.log(11))])
def test_idf(spark, freq, total, want):
    assert spark.range(1).select(score.idf(F.lit(freq), total).alias("x")).first().x == pytest.approx(want, abs=1e-9)


def segments(spark, rows):
    return spark.createDataFrame([(k, "S", bytearray(sp), o, 1) for k, sp, o in rows], "asset_key long, sp_type string, sp binary, offset long, size long")


def asked(spark, sps):
    return spark.createDataFrame([(1, i, "S", bytearray(sp)) for i, sp in enumerate(sps)], "query_id long, sp_pos long, sp_type string, sp binary")


A, B, C = (bytes([x] * 8) for x in (1, 2, 3))


@pytest.mark.parametrize(
    "stored, sps, want",
    [
        ([(1, A, 0)], [A], {1: (1.0, 1)}),
        ([(1, A, 0), (1, B, 1), (2, A, 0)], [A, B], {1: (0.5, 2), 2: (0.5, 1)}),
        ([(1, A, 0), (1, B, 1), (2, A, 0), (2, B, 1)], [A, B], {1: (1.0, 2), 2: (1.0, 2)}),
        ([(1, A, 0), (1, A, 5)], [A, B], {1: (0.5, 2)}),
        ([(1, A, 0), (1, B, 1), (1, C, 2), (2, B, 0), (2, C, 0), (3, C, 0), (4, C, 0)], [A, B, C], {1: (0.444444444, 3), 2: (1 / 3, 2), 3: (1 / 3, 1), 4: (1 / 3, 1)}),
    ],
)
def test_coverage_quality(spark, stored, sps, want):
    found = match.segment_exact(segments(spark, stored), asked(spark, sps))
    got = {r.asset_key: (r.score, r.matches) for r in score.coverage_quality(found, asked(spark, sps), 0.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-9) and got[k][1] == want[k][1] for k in want)


def test_idf_weighted_counts_stored_and_unmatched(spark):
    near = spark.createDataFrame([(1, "S", 0, bytearray(A), 7, bytearray(C), 0, 1, 0.9)], "query_id long, sp_type string, sp_pos long, q_sp binary, asset_key long, sp binary, offset long, size long, score double")
    freqs = spark.createDataFrame([("S", bytearray(C), 1), ("S", bytearray(B), 4), ("S", bytearray(A), 9)], "sp_type string, sp binary, freq long")
    row = score.idf_weighted(near, asked(spark, [A, B]), freqs, 10).first()
    assert row.score == pytest.approx(0.557915610, abs=1e-9) and (row.matches, row.queried) == (1, 2)


def units(spark, rows):
    frame = spark.createDataFrame([(k, t, len(b) * 8, bytearray(b)) for k, t, b in rows], "asset_key long, unit_type string, nbits int, body binary")
    return frame.select("asset_key", "unit_type", "nbits", *(w.alias(f"w{i}") for i, w in enumerate(codec.words(F.col("body")))), "body")


def queries(spark, rows):
    return units(spark, rows).withColumnRenamed("asset_key", "query_id").withColumn("unit_pos", F.lit(0))


@pytest.mark.parametrize(
    "stored, query, want",
    [(bytes(8), bytes(32), 1.0), (bytes(8), bytes([255, 255]) + bytes(6), 0.75), (bytes(4), bytes([0, 0, 0, 1]), 1 - 1 / 32), (bytes(12), bytes(8) + bytes([255] * 4), 1 - 32 / 96), (bytes([255] * 8), bytes(8), 0.0)],
)
def test_nphd(spark, stored, query, want):
    found = match.nphd_nearest(units(spark, [(1, "CONTENT_TEXT_V0", stored)]), queries(spark, [(9, "CONTENT_TEXT_V0", query)]))
    assert found.first().score == pytest.approx(want)


def test_instance_prefix_matrix(spark):
    body = bytes(range(32))
    stored = units(spark, [(n, "INSTANCE_NONE_V0", body[: n // 8]) for n in (64, 128, 192, 256)])
    for bits, want in ((64, {64, 128, 192, 256}), (128, {64, 128, 192, 256}), (192, {64, 192, 256}), (256, {64, 128, 256})):
        got = {r.asset_key for r in match.prefix_join_binary(stored, queries(spark, [(1, "INSTANCE_NONE_V0", body[: bits // 8])])).collect()}
        assert got == want


def test_prefix_scores_are_means_over_query_units(spark):
    stored = units(spark, [(1, "DATA_NONE_V0", bytes(8))])
    both = queries(spark, [(1, "DATA_NONE_V0", bytes(32)), (1, "META_NONE_V0", bytes([1] * 32))])
    assert search.search_prefix(stored, both).first().score == pytest.approx(0.125)
    same = queries(spark, [(1, "DATA_NONE_V0", bytes(8)), (1, "DATA_NONE_V0", bytes([1] * 8))])
    assert search.search_prefix(stored, same).first().score == pytest.approx(0.5)


def test_queries_in_blocks_give_the_same(spark, sf_dir):
    stored, wanted = fixtures.content_units(spark, sf_dir), fixtures.query_units(spark, sf_dir)
    whole = match.nphd_nearest(stored, wanted, 5)
    parts = match.nphd_nearest(stored, wanted, 5, block=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


@pytest.mark.parametrize("nbytes", [4, 8, 16])
def test_banded_recall(spark, nbytes):
    """Against brute force, of codes that differ in up to a quarter of their bits: 0.9 at least, and all of the near ones."""
    import random

    random.seed(nbytes)
    base = [random.randbytes(nbytes) for _ in range(60)]
    stored = [(1000 * i + j, "CONTENT_TEXT_V0", flipped(random, b, random.randint(0, nbytes * 2))) for i, b in enumerate(base) for j in range(25)]
    args = units(spark, stored), queries(spark, [(i, "CONTENT_TEXT_V0", b) for i, b in enumerate(base)])
    exact, banded = ({(r.query_id, r.asset_key): r.score for r in match.nphd_nearest(*args, 1500, nearest=n).collect() if r.score >= 0.75} for n in ("exact", "banded"))
    assert banded.items() <= exact.items() and len(exact) >= 1500
    assert len(banded) >= 0.9 * len(exact)
    if nbytes <= 8:
        assert all(k in banded for k, s in exact.items() if s >= 0.79)
    rows = match.nphd_nearest(*args, 1500, nearest="banded").select("query_id", "asset_key")
    assert rows.count() == rows.distinct().count()


def flipped(random, code, bits):
    number = int.from_bytes(code, "big")
    for at in random.sample(range(8 * len(code)), bits):
        number ^= 1 << at
    return number.to_bytes(len(code), "big")


def test_banded_segments_recall(spark):
    import random

    random.seed(2)
    base = [random.randbytes(8) for _ in range(40)]
    stored = segments(spark, [(1000 * i + j, flipped(random, b, random.randint(0, 16)), 0) for i, b in enumerate(base) for j in range(25)])
    found = [{(r.sp_pos, r.asset_key) for r in match.segment_nearest(stored, asked(spark, base), 100, nearest=n).collect() if r.score >= 0.75} for n in ("exact", "banded")]
    assert found[1] <= found[0] and len(found[1]) >= 0.9 * len(found[0]) >= 900


@pytest.mark.parametrize("block", [10_000, 5])
@pytest.mark.parametrize("nbytes", [1, 4, 8, 9, 20, 31])
def test_nearest_segments_against_brute_force(spark, nbytes, block):
    """Copies, negative keys, another length and another type beside the codes asked for, fewer rows than the limit, blocks."""
    import random

    random.seed(nbytes)
    base = [random.randbytes(nbytes) for _ in range(20)]
    rows = [(random.choice((1, -1)) * (100 * i + j), "S", base[0] if j < 12 else flipped(random, b, random.randint(0, nbytes)), j % 3) for i, b in enumerate(base) for j in range(20)]
    rows += [(9000, "S", base[0] + b"x", 0), (9001, "T", base[0], 0), (9002, "S", base[1] + b"y", 7)]
    stored = spark.createDataFrame([(k, t, bytearray(sp), o, 1) for k, t, sp, o in rows], "asset_key long, sp_type string, sp binary, offset long, size long")
    wanted = [(q, i, "S", bytearray(sp)) for q in (1, 2) for i, sp in enumerate([*base, base[1] + b"z"])]
    queries = spark.createDataFrame(wanted, "query_id long, sp_pos long, sp_type string, sp binary")
    found = match.segment_nearest(stored, queries, 5, 1, block)
    got = {(r.query_id, r.sp_pos, r["rank"]): (r.asset_key, bytes(r.sp), r.offset, round(r.score, 9)) for r in found.collect()}
    leads = {}
    for k, t, sp, o in rows:
        leads[k, t, o] = min(leads.get((k, t, o), sp), sp)
    want = {}
    for q, i, t, sp in wanted:
        bits = 8 * len(sp)
        near = [(int.from_bytes(s, "big") ^ int.from_bytes(sp, "big"), k, s, o) for (k, kind, o), s in leads.items() if kind == t and len(s) == len(sp)]
        near = sorted((x.bit_count(), k % 2**64, o, k, s) for x, k, s, o in near)[:10]
        want |= {(q, i, at + 1): (k, s, o, round(1 - d / bits, 9)) for at, (d, _, o, k, s) in enumerate(near)}
    assert got == want


def test_nearest_segments_make_no_row_a_pair(spark):
    """Of 400 codes against 2000, one of them 500 times, only rows near enough leave the comparison, of copies as many as asked for."""
    import random

    random.seed(3)
    rows = [(k, random.randbytes(8), 0) for k in range(1500)] + [(k, A, 0) for k in range(1500, 2000)]
    stored = match.with_leads(segments(spark, rows))
    codes = [A, *(random.randbytes(8) for _ in range(399))]
    words = [w.alias(f"q_{n}") for n, w in zip(match.WORDS, codec.words(F.col("q_sp")), strict=True)]
    queries = asked(spark, codes).select(F.col("sp_type").alias("q_type"), F.col("sp").alias("q_sp")).select("*", *words)
    near = match.codes_nearest(stored, queries, 5, 10_000)
    assert near.count() < 60 * len(codes) < len(rows) * len(codes) / 30
    assert near.filter(F.col("q_sp") == F.lit(A)).select("asset_key").distinct().count() < 500


def test_equal_segments_beyond_a_block_and_the_cap(spark):
    """Shuffled or broadcast, cut at dup_limit in key order; a segment asked for twice is found twice; stored rows are read once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = segments(spark, [*((k, A, 0) for k in (5, -1, 3, 9)), (4, B, 2), (7, C, 0)])
    stored = stored.mapInArrow(counted, stored.schema)
    queries = asked(spark, [A, B, A, bytes(8)])
    for block in (10_000, 1):
        seen.value = 0
        found = {(r.sp_pos, r.asset_key) for r in match.segment_exact(stored, queries, 3, block).collect()}
        assert found == {(p, k) for p in (0, 2) for k in (3, 5, 9)} | {(1, 4)}
        assert seen.value == 6


def test_matches_are_moved_once_for_coverage(spark):
    """Equal segments bring their frequencies, which are those counted among the matches, and one shuffle groups them."""
    stored, queries = segments(spark, [(1, A, 0), (1, A, 5), (2, A, 0), (2, B, 1), (3, C, 0)]), asked(spark, [A, B])
    matches = match.segment_exact(stored, queries)
    found = score.coverage_quality(matches, queries, 0.0)
    assert sorted(map(str, found.collect())) == sorted(map(str, score.coverage_quality(matches.drop("freq"), queries, 0.0).collect()))
    assert {(r.asset_key, bytes(r.sp), r.freq) for r in matches.collect()} == {(1, A, 2), (2, A, 2), (2, B, 1)}
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "asset_key" in line for line in plan.splitlines()) == 1


def test_exact_segment_search_reads_segments_once(spark):
    """However many blocks the query segments would fill, with the same results."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = segments(spark, [(1, A, 0), (1, B, 1), (2, A, 0), (3, C, 0), (3, B, 2)])
    stored = stored.mapInArrow(counted, stored.schema)
    found = []
    for block in (10_000, 1):
        seen.value = 0
        rows = search.search_segments(stored, asked(spark, [A, B, C]), 0, True, Options(threshold_simprints=0.0, query_block=block)).collect()
        found.append(sorted((r.asset_key, round(r.score, 9), r["rank"]) for r in rows))
        assert seen.value == 5
    assert found[0] == found[1] and len(found[0]) == 3


@pytest.mark.parametrize("threshold, block", [(0.65, 10_000), (0.0, 1)])
def test_exact_scores_make_no_row_a_match(spark, monkeypatch, threshold, block):
    """The scores and chunks of all matches, from a row a class of segments; a frequent segment alone makes no candidate."""
    import random

    random.seed(5)
    sps = [random.randbytes(8) for _ in range(60)]
    rows = [(k, sp, i) for k in range(-5, 15) for i, sp in enumerate(sps[:40])] + [(k, sps[39], 0) for k in range(100, 150)]
    rows += [(k, sp, i) for k in range(200, 230) for i, sp in enumerate(random.sample(sps, random.randint(1, 60)) * random.randint(1, 2))]
    stored, queries = segments(spark, rows), asked(spark, [*sps[:40], sps[0], bytes(8)])
    queries = queries.unionByName(asked(spark, sps[30:]).withColumn("query_id", F.lit(2).cast("long"))).unionByName(asked(spark, [bytes(8)]).withColumn("query_id", F.lit(3).cast("long")))
    kept, write = {}, score.stored
    monkeypatch.setattr(score, "stored", lambda frame, label: kept.setdefault(label, write(frame, label)))
    options = Options(threshold_simprints=threshold, query_block=block, limit=100)
    found = search.search_segments(stored, queries, 0, True, options)
    want = score.coverage_quality(match.segment_exact(stored, queries), queries, threshold)
    want = score.top_k(score.mean_over_types(score.top_k(want, 200, ("query_id", "sp_type")).drop("rank")), 100)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    # 2 rows asked for and held by 20 copies would make 800 rows alone.
    assert kept["asked-classes"].count() < 100 and (threshold == 0 or kept["pairs"].count() < 90)
    kept.clear()
    short = search.search_segments(stored, queries, 0, True, options, chunks=False).select("query_id", "asset_key", "score", "rank", F.map_values("types")[0].alias("d"))
    assert "chunks" not in short.schema["d"].dataType.names
    assert sorted((r.query_id, r.asset_key, r.score, r["rank"], *r.d) for r in short.collect()) == sorted((r.query_id, r.asset_key, r.score, r["rank"], *r.types["S"][:3]) for r in found.collect())


@pytest.mark.parametrize("freqs, queried", [([990, 993, 993, 994], 4), ([30] * 85 + [70] * 43, 128), ([991, 999, 1000], 5), ([7] * 3, 3), ([1, 5_000_000], 2)])
def test_exact_scores_are_right_in_their_last_places(spark, freqs, queried):
    """Frequencies close to each other, and scores that lie midway between two of six places: the sum is right, the rest as in SQL."""
    from fractions import Fraction

    sps = [i.to_bytes(8, "big") for i in range(queried)]
    rows = [("S", bytearray(sp), 1, 0, 1, f) for sp, f in zip(sps, freqs, strict=False)]
    held = spark.createDataFrame(rows, "sp_type string, sp binary, asset_key long, offset long, size long, freq long")
    mean, least, most = float(sum(Fraction(1, f) for f in freqs)) / len(freqs), 1 / max(freqs), 1 / min(freqs)
    want = len(freqs) / queried * (1 if least == most else (mean - least) / (most - least))
    queries = asked(spark, sps)
    matches = held.join(queries, ["sp_type", "sp"])
    for found in (score.coverage_scores(held, queries, 0.0), score.coverage_quality(matches, queries, 0.0)):
        assert [r.score for r in found.collect()] == [want]


def test_segments_that_nobody_asks_for_are_not_shuffled(spark):
    """Beyond a block of queries, marks leave nearly all others out before the join, and keep all that are asked for."""
    import random

    random.seed(6)
    sps = [random.randbytes(8) for _ in range(3000)]
    rows, wanted = segments(spark, [(k, sp, 0) for k, sp in enumerate(sps)]), asked(spark, sps[:100]).select(F.col("sp_type").alias("q_type"), F.col("sp").alias("q_sp"))
    left = {r.asset_key for r in match._marked(rows, wanted, 100).collect()}
    assert left >= set(range(100)) and len(left) < 200


def test_nearest_segment_search_reads_segments_twice(spark):
    """Once to compare and once for frequencies, however many blocks the query segments fill, with the same results."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = match.with_leads(segments(spark, [(1, A, 0), (1, B, 1), (2, A, 0), (3, C, 0), (3, B, 2)]))
    stored = stored.mapInArrow(counted, stored.schema)
    found = []
    for block in (10_000, 1):
        seen.value = 0
        rows = search.search_segments(stored, asked(spark, [A, B, C]), 3, options=Options(query_block=block)).collect()
        found.append(sorted((r.asset_key, round(r.score, 9), r["rank"]) for r in rows))
        assert seen.value <= 10
    assert found[0] == found[1] and len(found[0]) == 3


@pytest.mark.parametrize("block", [10_000, 1])
def test_near_segments_are_kept_once_for_all_queries(spark, monkeypatch, block):
    """A row for a code and an asset, however many queries and segments of the asset, with the scores and chunks of all rows."""
    import random

    random.seed(7)
    base = [random.randbytes(8) for _ in range(12)]
    rows = [(k, flipped(random, b, random.randint(0, 20)), i) for k in range(-3, 12) for i, b in enumerate(random.sample(base, 6) * 2)]
    stored = match.with_leads(segments(spark, [*rows, (50, base[0], 0), (51, base[0], 0)]))
    own = [(q, i, "S", bytearray(sp)) for q in range(8) for i, sp in enumerate([*base[: 5 + q % 2], base[0], base[11]])]
    queries = spark.createDataFrame(own, "query_id long, sp_pos long, sp_type string, sp binary")
    kept, write = {}, search.stored
    monkeypatch.setattr(search, "stored", lambda frame, label: kept.setdefault(label, write(frame, label)))
    options = Options(threshold_simprints=0.65, query_block=block, limit=10, oversampling=3)
    found = search.search_segments(stored, queries, 17, options=options)
    near = match.segment_nearest(stored, queries, 10, 3, block)
    want = score.idf_weighted(near, queries, score.document_frequency(stored), 17, 0.65)
    want = score.top_k(score.mean_over_types(score.top_k(want, 20, ("query_id", "sp_type")).drop("rank")), 10)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    met = near.filter("score >= 0.65")
    assert kept["near-segments"].count() == met.select("q_sp", "asset_key").distinct().count() < met.count() / 8
    assert kept["frequencies"].count() <= len(rows) + 12


def test_short_codes_meet_by_prefix(spark):
    """Codes of 32 bits are found by longer ones and find them."""
    body = bytes(range(1, 9))
    stored = units(spark, [(1, "DATA_NONE_V0", body[:4]), (2, "DATA_NONE_V0", body), (3, "DATA_NONE_V0", bytes(4))])
    for n, want in ((4, {1: 32, 2: 32}), (8, {1: 32, 2: 64})):
        assert {r.asset_key: r.matched_bits for r in match.prefix_join_graded(stored, queries(spark, [(1, "DATA_NONE_V0", body[:n])])).collect()} == want


def test_options_are_checked():
    assert Options().override(limit=3).limit == 3
    for bad in ({"mode": "other"}, {"nearest": "other"}, {"threshold_units": 2}, {"limit": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def entries(spark, rows):
    return spark.createDataFrame(rows, "iscc_id string, iscc_code string, units array<string>, metadata string, pos long")


@pytest.fixture(scope="module")
def material(spark, sf_dir):
    return [r.asDict() for r in fixtures.assets(spark, sf_dir).orderBy("asset_key").limit(4).collect()]


def test_catalog(spark, tmp_path, material):
    catalog = Catalog(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError):
        catalog.create("Bad-name")
    with pytest.raises(FileNotFoundError):
        catalog.get("missing")
    index = catalog.create("first")
    with pytest.raises(FileExistsError):
        catalog.create("first")
    rows = [(m["iscc_id"], m["iscc_code"], m["units"], m["metadata"], i) for i, m in enumerate(material)]
    got = index.upsert(entries(spark, [*rows[:3], rows[0]]))
    assert sorted(r.status for r in got.collect()) == ["created", "created", "created", "updated"]
    again = index.upsert(entries(spark, rows))
    assert sorted(r.status for r in again.collect()) == ["created", "updated", "updated", "updated"]
    stats = index.stats()
    assert stats["assets"] == 4 and stats["types"] == {"DATA_NONE_V0": 4, "INSTANCE_NONE_V0": 4}
    before = sorted(map(str, index.table("units").collect()))
    index.rebuild()
    assert sorted(map(str, index.table("units").collect())) == before
    found = index.search(spark.createDataFrame([(1, material[0]["iscc_id"], None, None), (2, None, material[1]["iscc_code"], None)], "query_id long, iscc_id string, iscc_code string, units array<string>")).collect()
    assert {(r.query_id, r.iscc_id) for r in found} == {(2, material[1]["iscc_id"])} and found[0].metadata == material[1]["metadata"]
    missing = index.get(spark.createDataFrame([(codec_id,) for codec_id in (material[0]["iscc_id"], "ISCC:MAIGIIFJRDGEQQAA", "no")], "iscc_id string"))
    assert sorted(str(r.error) for r in missing.collect()) == ["None", "no_prefix", "not_found"]
    with pytest.raises(ValueError):
        index.upsert(entries(spark, [(code_of_realm_one(spark), None, material[0]["units"], None, 0)]))
    update = (rows[0][0], None, material[1]["units"][1:], None, 9)
    index.upsert(entries(spark, [update]))
    own = index.table("units").filter(F.col("asset_key") == material[0]["asset_key"]).collect()
    assert sorted(u.unit_type for u in own) == ["DATA_NONE_V0", "INSTANCE_NONE_V0"]
    assert catalog.list() == ["first"]
    catalog.delete("first")
    assert catalog.list() == []
    catalog.close()
    catalog.close()


def code_of_realm_one(spark):
    return spark.range(1).select(codec.id_from_key(F.lit(77).cast("long"), 1).alias("x")).first().x


def test_asset_files(spark, tmp_path, material):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    feature = {"maintype": "content", "subtype": "text", "version": 0, "simprints": ["AAAAAAAAAAA"], "offsets": [0], "sizes": [4]}
    (folder / "a.iscc.json").write_text(json.dumps({"iscc_id": material[0]["iscc_id"], "iscc": "ISCC:X", "name": "  A  ", "features": [feature], "other": 1}))
    (folder / "b.iscc.json").write_text(json.dumps({"iscc_id": material[0]["iscc_id"], "iscc_code": "ISCC:Y", "iscc": "ISCC:X", "name": " "}, indent=1))
    (folder / "c.iscc.json").write_text("{broken")
    (folder / "d.json").write_text("{}")
    good, bad = asset_sources.entries_of_files(asset_sources.asset_files(spark, f"file://{tmp_path}/in"))
    rows = {r.source.rsplit("/", 1)[1]: r for r in good.collect()}
    assert set(rows) == {"a.utf8", "b.utf8"} and all(r.twice for r in rows.values())
    assert rows["a.utf8"].iscc_code == "ISCC:X" and rows["a.utf8"].metadata == '{"name":"A"}' and rows["a.utf8"].simprints[0].sp_type == "CONTENT_TEXT_V0"
    assert rows["b.utf8"].iscc_code == "ISCC:Y" and rows["b.utf8"].metadata is None
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["c.iscc.json"]


def test_dataset_rows_are_pruned(spark, sf_dir):
    rows = asset_sources.dataset_rows(spark, f"{sf_dir}/embeddings.parquet", 5)
    assert rows.columns == ["vec_id", "label", "iscc", "iscc_meta", "iscc_semantic", "iscc_content", "iscc_data", "iscc_instance"]
    assert asset_sources.entries_of_rows(rows, "x").isEmpty()


def test_hub_list(spark, tmp_path):
    path = tmp_path / "hubs.json"
    path.write_text(json.dumps({"version": 1, "network": "testnet", "hubs": [{"hub_id": 0, "url": "https://a/", "active": True}, {"hub_id": 1, "url": "https://b", "active": False}]}))
    assert [tuple(r) for r in tlog.hub_list(spark, f"file://{path}", "testnet").collect()] == [(0, "https://a")]
    with pytest.raises(ValueError):
        tlog.hub_list(spark, f"file://{path}", "mainnet")


@pytest.mark.parametrize("last, tree, want", [(0, 300, [(0, 0, 0), (1, 44, 0)]), (256, 256, []), (300, 512, [(1, 0, 44)]), (0, 256, [(0, 0, 0)]), (512, 100, [])])
def test_bundle_plans(spark, last, tree, want):
    hubs = spark.createDataFrame([(1, last, tree)], "hub_id long, last_size long, tree_size long")
    assert sorted((r.bundle, r.width, r["skip"]) for r in tlog.plan_bundles(hubs).collect()) == want


@pytest.mark.parametrize("bundle, width, path", [(1234067, 0, "x001/x234/067"), (5, 0, "005"), (1000, 44, "x001/000.p/44")])
def test_bundle_paths(spark, bundle, width, path):
    assert spark.range(1).select(tlog.entries_path(F.lit(bundle), F.lit(width)).alias("p")).first().p == f"tile/entries/{path}"


def test_bundle_frames():
    records = [b"", b"a", b"x" * 65_535]
    assert tlog.split_bundle(tlog.frame_records(records)) == records
    for broken in (b"\0", b"\0\5abc"):
        with pytest.raises(ValueError):
            tlog.split_bundle(broken)


def test_stream_equals_batch_and_replays(spark, sf_dir, tmp_path):
    log = fixtures.log_records(spark, sf_dir).filter("event_id < 300").select("hub_id", "leaf_index", "record")
    parts = tmp_path / "log"
    for i in range(2):
        log.filter(F.col("leaf_index") % 2 == i).coalesce(1).write.mode("append").parquet(f"file://{parts}")
    catalog = Catalog(spark, f"file://{tmp_path}/index")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{parts}")
    followed = catalog.create("followed")
    for checkpoint in ("one", "one", "two"):  # the second run has nothing to do, the third replays all
        ingest.follow(stream, followed, "testnet", f"file://{tmp_path}/{checkpoint}").awaitTermination()
    batch = catalog.create("batch")
    ok = ingest.classify(log, "testnet").filter("reason = 'ok'")
    batch.upsert(ok.select("iscc_id", "iscc_code", "units", "metadata", F.struct(F.col("leaf_index") % 2, "leaf_index", "hub_id").alias("pos")))
    assert followed.table("assets").count() == batch.table("assets").count() > 0
    assert {r.iscc_id for r in followed.table("assets").collect()} == {r.iscc_id for r in batch.table("assets").collect()}


def test_fingerprints_ignore_order(spark):
    rows = [(1, A, 0), (1, B, 1), (2, B, 1), (2, A, 0), (3, A, 0)]
    prints = {r.asset_key: r.fingerprint for r in upsert.fingerprint(segments(spark, rows)).collect()}
    assert prints[1] == prints[2] != prints[3]


def simprint(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


WITH_SIMPRINTS = "iscc_id string, iscc_code string, units array<string>, metadata string, pos long, simprints array<struct<sp_type:string, simprint:string, offset:long, size:long>>"


def test_segments_in_an_index(spark, tmp_path, material):
    """Stored, replaced by type, searched in both ways, rebuilt and counted."""
    index = Catalog(spark, f"file://{tmp_path}", Options(buckets=4)).create("segments")
    a, b, c = simprint(A), simprint(B), simprint(C)
    first = [(a, 0), (b, 1)], [(a, 0)], [(c, 0)], []
    entries_ = lambda listed, kind="S": [(m["iscc_id"], m["iscc_code"], m["units"], m["metadata"], i, [(kind, s, o, 1) for s, o in own]) for i, (m, own) in enumerate(zip(material, listed, strict=False))]
    rows = entries_(first)
    rows[1][5].append(("T", b, 0, 1))
    rows[1][5].append(("T", b, 0, 1))  # the same segment twice
    rows[0][5].append(("T", "!", 0, 1))  # no base64
    index.upsert(spark.createDataFrame(rows, WITH_SIMPRINTS))
    stats = index.stats()
    assert stats["segment_types"] == {"S": 4, "T": 1} and stats["segment_bits"] == {"S": 64, "T": 64}
    asked = spark.createDataFrame([(1, {"S": [a, b], "T": [b]}), (2, {"S": [c]})], "query_id long, simprints map<string,array<string>>")
    exact = {(r.query_id, r.iscc_id): r for r in index.search_segments(asked, exact=True).collect()}
    ids = [m["iscc_id"] for m in material]
    assert {k: r.score for k, r in exact.items()} == {(1, ids[1]): pytest.approx(1.0), (2, ids[2]): 1.0}  # a type's score of a half is below the threshold
    found = exact[1, ids[1]]
    assert set(found.types) == {"T"} and found.types["T"].chunks[0].query == b and found.metadata == material[1]["metadata"] and found.source == json.loads(found.metadata)["source"]
    near = {(r.query_id, r.iscc_id): r for r in index.search_segments(asked).collect()}
    assert {(1, ids[0]), (1, ids[1]), (2, ids[2])} <= set(near)
    assert near[1, ids[1]].types["T"].score == pytest.approx(1.0) and near[1, ids[0]].types["S"].matches == 2
    # An update replaces the segments of its types and leaves the others; other buckets' files stay.
    before = index.manifest()
    index.upsert(spark.createDataFrame([(*entries_([(), [(c, 5)]])[1][:4], 9, [("S", c, 5, 1)])], WITH_SIMPRINTS))
    after = index.manifest()
    changed = {(t, k) for t in after["tables"] for k in after["tables"][t] if after["tables"][t][k] != before["tables"][t].get(k)}
    assert len({k for _, k in changed}) == 1 and after["generation"] == before["generation"] + 1
    own = sorted((r.sp_type, bytes(r.sp), r.offset) for r in index.segments(spark.createDataFrame([(ids[1],)], "iscc_id string")).collect())
    assert own == [("S", C, 5), ("T", B, 0)]
    both = index.search_all(spark.createDataFrame([(1, None, material[1]["iscc_code"], None, {"S": [c]}), (2, ids[1], None, None, {"S": [c]})], "query_id long, iscc_id string, iscc_code string, units array<string>, simprints map<string,array<string>>"), exact=True)
    assert {r.query_id for r in both.chunk_matches.collect()} == {1} and {(r.query_id, r.iscc_id) for r in both.global_matches.collect()} == {(1, ids[1])}
    rows = sorted(map(str, index.table("segments").collect()))
    index.rebuild()
    assert sorted(map(str, index.table("segments").collect())) == rows and index.check().isEmpty()


def test_index_search_reads_segments_once(spark, tmp_path, material):
    """The plan of an exact segment search does not grow with the blocks that the query segments would fill."""
    index = Catalog(spark, f"file://{tmp_path}", Options(buckets=2, query_block=1)).create("once")
    listed = [[("S", simprint(x), i, 1) for i, x in enumerate((A, B, C))], [("S", simprint(A), 0, 1), ("T", simprint(A), 0, 1), ("T", simprint(A), 0, 1)]]
    index.upsert(spark.createDataFrame([(m["iscc_id"], m["iscc_code"], m["units"], m["metadata"], i, own) for i, (m, own) in enumerate(zip(material, listed, strict=False))], WITH_SIMPRINTS))
    asked = spark.createDataFrame([(1, {"S": [simprint(bytes([x] * 8)) for x in range(1, 41)]})], "query_id long, simprints map<string,array<string>>")
    found = index.search_segments(asked, exact=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6
    assert index.stats()["segment_types"] == {"S": 4, "T": 1}


def test_replays_write_nothing_and_writers_conflict(spark, tmp_path, material):
    index = Catalog(spark, f"file://{tmp_path}", Options(buckets=4)).create("replays")
    rows = [(m["iscc_id"], m["iscc_code"], m["units"], m["metadata"], i, [("S", simprint(A), i, 1)]) for i, m in enumerate(material)]
    frame = spark.createDataFrame(rows, WITH_SIMPRINTS)
    index.upsert(frame)
    listed = sorted(str(p) for p in tmp_path.rglob("*"))
    times = [p.stat().st_mtime_ns for p in sorted(tmp_path.rglob("*")) if p.is_file()]
    again = index.upsert(frame.orderBy(F.desc("pos")).withColumn("pos", 10 - F.col("pos")))
    assert {r.status for r in again.collect()} == {"updated"}
    assert sorted(str(p) for p in tmp_path.rglob("*")) == listed and [p.stat().st_mtime_ns for p in sorted(tmp_path.rglob("*")) if p.is_file()] == times
    # Two writers that read one state: the second is told, and its files go.
    state = index.manifest()
    index.manifest = lambda: state
    index.upsert(spark.createDataFrame([(*rows[0][:3], "{}", 0, None)], WITH_SIMPRINTS))
    with pytest.raises(Conflict):
        index.upsert(spark.createDataFrame([(*rows[1][:3], "{}", 0, None)], WITH_SIMPRINTS))
    del index.manifest
    assert index.manifest()["generation"] == 2 and index.table("segments").count() == 4
    named = {f.split("/")[0] for m in (index.manifest(), state) for t in m["tables"].values() for f in t.values()}
    assert {p.name for p in (tmp_path / "replays").iterdir() if p.is_dir()} == named


def test_load_in_batches(spark, tmp_path, material):
    """Batches in order; a batch that fails is reported and the others are written."""
    index = Catalog(spark, f"file://{tmp_path}").create("load")
    rows = [(m["iscc_id"], m["iscc_code"], m["units"], m["metadata"], i) for i, m in enumerate(material)] + [("broken", None, None, None, 4)]
    statuses, errors = index.load(entries(spark, rows), batch_rows=1)
    assert sorted(r.pos for r in statuses.collect()) == [0, 1, 2, 3] and len(errors) == 1 and "invalid id" in errors[0]
    statuses, errors = index.load(entries(spark, rows[:4]))
    assert sorted(r.status for r in statuses.collect()) == ["updated"] * 4 and not errors


def test_asset_files_into_an_index(spark, tmp_path, material):
    """From files to chunk matches, with the source that the files name."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, m in enumerate(material[:2]):
        feature = {"maintype": "content", "subtype": "text", "version": 0, "simprints": [simprint(A), simprint(bytes([i] * 8))], "offsets": [0, 4], "sizes": [4, 4]}
        (folder / f"{i}.iscc.json").write_text(json.dumps({"iscc_id": m["iscc_id"], "iscc_code": m["iscc_code"], "units": m["units"], "name": f"n{i}", "features": [feature]}))
    found, _ = asset_sources.entries_of_files(asset_sources.asset_files(spark, f"file://{folder}"))
    index = Catalog(spark, f"file://{tmp_path}/index").create("files")
    statuses, errors = index.load(asset_sources.numbered(found))
    assert not errors and statuses.count() == 2
    rows = index.search_segments(spark.createDataFrame([(1, {"CONTENT_TEXT_V0": [simprint(A)]})], "query_id long, simprints map<string,array<string>>"), exact=True).collect()
    assert {r.source.rsplit("/", 1)[1] for r in rows} == {"0.utf8", "1.utf8"} and {json.loads(r.metadata)["name"] for r in rows} == {"n0", "n1"}


def test_dataset_splits(spark, tmp_path, sf_dir):
    for split in ("train", "test"):
        spark.range(3).selectExpr("'ISCC:X' as iscc", "id").write.parquet(f"file://{tmp_path}/data/{split}-00")
    assert asset_sources.dataset_rows(spark, f"file://{tmp_path}/data", split="TRAIN").count() == 3
    with pytest.raises(FileNotFoundError):
        asset_sources.dataset_rows(spark, f"file://{tmp_path}/data", split="dev")


def write_log(folder, records, size=None, broken=()):
    """A hub's log of records, as far as size."""
    size = len(records) if size is None else size
    (folder / "log").mkdir(parents=True, exist_ok=True)
    (folder / "log" / "checkpoint").write_text(f"hub\n{size}\nroot\n")
    for bundle in range(0, -(-size // tlog.WIDTH)):
        own = records[bundle * tlog.WIDTH : min(size, (bundle + 1) * tlog.WIDTH)]
        at = folder / "log" / "tile" / "entries" / (f"{bundle:03d}" + (f".p/{len(own)}" if len(own) < tlog.WIDTH else ""))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(tlog.frame_records(own)[: -1 if bundle in broken else None])


def test_poller(spark, sf_dir, tmp_path):
    """Partial bundles, a broken one, a tree that shrinks, hubs that go, and a restart."""
    rows = fixtures.log_records(spark, sf_dir).orderBy("leaf_index").collect()
    logs = {h: [bytes(r.record) for r in rows if r.hub_id == h] for h in (0, 1)}
    logs[1] = logs[1] + logs[1][:100]
    hub_list = tmp_path / "hubs.json"
    listing = {"version": 1, "network": "testnet", "hubs": [{"hub_id": h, "url": f"file://{tmp_path}/hub{h}/", "active": True} for h in logs]}
    hub_list.write_text(json.dumps(listing))
    write_log(tmp_path / "hub0", logs[0], 300)
    write_log(tmp_path / "hub1", logs[1], broken=(1,))
    index = Catalog(spark, f"file://{tmp_path}/index").create("idptest")
    poller = Poller(spark, index, f"file://{hub_list}", "testnet", f"file://{tmp_path}/state")
    assert poller.refresh()
    first = {s["hub_id"]: s for s in poller.poll()}
    assert first[0]["cursor"] == 300 and first[0]["ok"] and sum(first[0]["counts"].values()) == 300
    assert first[1]["cursor"] == 256 and not first[1]["ok"] and first[1]["error"] == "poll failed" and sum(first[1]["counts"].values()) == 256
    write_log(tmp_path / "hub0", logs[0])
    write_log(tmp_path / "hub1", logs[1])
    again = Poller(spark, index, f"file://{hub_list}", "testnet", f"file://{tmp_path}/state")
    assert again.refresh()
    second = {s["hub_id"]: s for s in again.poll()}
    assert all(second[h]["cursor"] == len(logs[h]) and second[h]["ok"] and sum(second[h]["counts"].values()) == len(logs[h]) for h in logs)
    whole = Catalog(spark, f"file://{tmp_path}/index").create("whole")
    log = spark.createDataFrame([(h, i, bytearray(r)) for h, own in logs.items() for i, r in enumerate(own)], "hub_id long, leaf_index long, record binary")
    whole.upsert(ingest.classify(log, "testnet").filter("reason = 'ok'").select("iscc_id", "iscc_code", "units", "metadata", F.struct("leaf_index", "hub_id").alias("pos")))
    assert {r.iscc_id for r in index.table("assets").collect()} == {r.iscc_id for r in whole.table("assets").collect()}
    # A shrunken tree is read from the start at the next poll.
    write_log(tmp_path / "hub0", logs[0], 10)
    assert [s["cursor"] for s in again.poll()] == [0, len(logs[1])]
    generation = index.manifest()["generation"]
    assert [s["cursor"] for s in again.poll()] == [10, len(logs[1])] and index.manifest()["generation"] >= generation
    # An empty or unreadable list changes nothing; a hub that goes is forgotten; one without a checkpoint is noted.
    hub_list.write_text(json.dumps(listing | {"hubs": []}))
    assert not again.refresh() and set(again.statuses) == {0, 1}
    hub_list.write_text(json.dumps(listing | {"hubs": [listing["hubs"][1], {"hub_id": 7, "url": f"file://{tmp_path}/none", "active": True}]}))
    assert again.refresh() and set(again.statuses) == {1}
    assert {s["hub_id"]: s["ok"] for s in again.poll()} == {1: True, 7: False}
    rounds = iter([False, False, True])
    again.run(lambda: next(rounds), lambda _: None)


def test_followed_state_of_logs_longer_than_a_poll(spark, sf_dir, duck, same, monkeypatch):
    """All bundles count, also those beyond the ones a poll reads of a hub."""
    from simloom.plans import queries

    monkeypatch.setattr(queries, "OPTIONS", queries.OPTIONS.override(poll_bundles=1))
    monkeypatch.setattr(queries._index, "__defaults__", (queries.OPTIONS,))
    query, sql = queries.QUERIES["i2_followed_state"]
    same(query(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table())


def test_bundles_take_no_call_of_the_driver_each(spark, sf_dir, duck, same, monkeypatch):
    """Executors write the logs, and a poll lists folders: the driver neither makes a bundle's file nor asks for it."""
    import re

    from simloom.plans import queries
    from simloom.store import Files

    seen = []
    for name in ("create", "exists", "qualified"):
        monkeypatch.setattr(Files, name, lambda self, path, *rest, call=getattr(Files, name): (seen.append(path), call(self, path, *rest))[1])
    query, sql = queries.QUERIES["i2_followed_state"]
    same(query(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table())
    assert seen and not [path for path in seen if re.search(r"/tile/entries/.*\d$", path)]
