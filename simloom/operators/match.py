"""Candidate joins: exact, prefix, nearest codes, segments.

Queries are the small side. They are matched in blocks of a counted size, each broadcast, so what
is broadcast never grows with the stored tables nor with the number of queries.

Frames:
    units    (asset_key, unit_type, nbits, w0..w3, body)
    queries  (query_id, unit_pos, unit_type, nbits, w0..w3, body)
    segments (asset_key, sp_type, sp, offset, size)
    query segments (query_id, sp_pos, sp_type, sp)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.codec import unsigned_order, words
from simloom.operators.hamming import WORDS
from simloom.operators.hamming import nearest as codes_nearest
from simloom.operators.upsert import with_leads
from simloom.store import stored


def in_blocks(queries: DataFrame, keys: tuple[str, ...], block: int, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of match(part) over parts of queries by keys, each of about `block` rows, hinted for broadcast.

    Queries are stored first, so they are computed once and counted from the files. A part has rows of any
    query: whatever ranks a query's matches comes after the union.
    """
    queries = stored(queries, "queries")
    parts = queries.count() // block + 1
    if parts == 1:
        return match(F.broadcast(queries))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    return reduce(DataFrame.unionByName, [match(F.broadcast(queries.filter(part == i))) for i in range(parts)])


def exact_code_join(assets: DataFrame, queries: DataFrame, block: int = 10_000) -> DataFrame:
    """(query_id, asset_key, score): assets whose composite code equals the query's; score 1."""
    asked = queries.select("query_id", F.col("iscc_code").alias("q_code"))

    def match(part: DataFrame) -> DataFrame:
        return assets.join(part, assets["iscc_code"] == F.col("q_code")).select("query_id", "asset_key", F.lit(1.0).alias("score"))

    return in_blocks(asked, ("query_id",), block, match)


def _asked(queries: DataFrame) -> DataFrame:
    names = {"unit_type": "q_type", "nbits": "q_nbits", "body": "q_body", **{w: f"q_{w}" for w in WORDS}}
    return queries.select("query_id", "unit_pos", *(F.col(c).alias(n) for c, n in names.items()))


def _prefix_join(units: DataFrame, queries: DataFrame, extra: Column, block: int) -> DataFrame:
    """Pairs where one body is a prefix of the other.

    Bodies of 64 bits and more meet by their first word, an equi key. Shorter ones, on either side, are met
    by as many bits as they have, length by length: bodies have whole 32 bits, so there is one length below 64.
    """
    either = F.col("body").startswith(F.col("q_body")) | F.col("q_body").startswith(F.col("body"))

    def match(part: DataFrame) -> DataFrame:
        short = (F.col("nbits") < 64) | (F.col("q_nbits") < 64)
        half = F.shiftright(units["w0"], 32) == F.shiftright("q_w0", 32)
        long = units.join(part, (units["unit_type"] == F.col("q_type")) & (units["w0"] == F.col("q_w0")) & ~short & either & extra)
        return long.unionByName(units.join(part, (units["unit_type"] == F.col("q_type")) & half & short & either & extra))

    return in_blocks(_asked(queries), ("query_id", "unit_pos"), block, match)


def prefix_join_graded(units: DataFrame, queries: DataFrame, block: int = 10_000) -> DataFrame:
    """(query_id, unit_pos, unit_type, q_nbits, asset_key, matched_bits): prefix matches in either direction."""
    found = _prefix_join(units, queries, F.lit(True), block)
    return found.select("query_id", "unit_pos", "unit_type", "q_nbits", "asset_key", F.least("nbits", "q_nbits").alias("matched_bits")).distinct()


def prefix_join_binary(units: DataFrame, queries: DataFrame, block: int = 10_000) -> DataFrame:
    """(query_id, unit_pos, unit_type, asset_key, score 1): prefix matches of instance codes.

    Shorter stored codes are found at 64 bits (for queries of 128 or more) and at 128 bits (for
    queries of 256); stored codes of 192 bits are found by queries that are not longer.
    """
    n, q = F.col("nbits"), F.col("q_nbits")
    lengths = (n >= q) | ((q >= 128) & (n == 64)) | ((q == 256) & (n == 128))
    found = _prefix_join(units.filter(F.col("unit_type").startswith("INSTANCE_")), queries, lengths, block)
    return found.select("query_id", "unit_pos", "unit_type", "asset_key", F.lit(1.0).alias("score")).distinct()


def hamming(left: list[Column], right: list[Column], bits: Column | None = None) -> Column:
    """Differing bits of 64-bit words, in the first `bits` bits if given."""

    def word(i: int) -> Column:
        differ = left[i].bitwiseXOR(right[i])
        if bits is None:
            return F.bit_count(differ)
        used = bits - 64 * i
        cut = differ.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(F.lit(0), F.least(F.lit(63), F.lit(64) - used)).cast("int")))
        return F.when(used >= 64, F.bit_count(differ)).when(used > 0, F.bit_count(cut)).otherwise(0)

    return reduce(Column.__add__, [word(i) for i in range(len(left))])


def nphd_score(nbits: Column, q_nbits: Column) -> Column:
    """1 - normalised prefix Hamming distance of w0..w3 and q_w0..q_w3, not below 0."""
    shared = F.least(nbits, q_nbits)
    distance = hamming([F.col(w) for w in WORDS], [F.col(f"q_{w}") for w in WORDS], shared)
    return F.greatest(F.lit(0.0), 1 - distance / shared)


@dataclass(frozen=True)
class Bands:
    """Where the bands of a code's first word start, their bits, and how many of these may differ."""

    starts: tuple[int, ...]
    bits: int
    radius: int

    def masks(self) -> list[int]:
        """Every value of a band with at most radius bits set."""
        return [sum(1 << i for i in chosen) for n in range(self.radius + 1) for chosen in combinations(range(self.bits), n)]

    def value(self, word: Column, start: int) -> Column:
        return F.shiftrightunsigned(word, 64 - self.bits - start).bitwiseAND(F.lit((1 << self.bits) - 1))


#: Codes of 64 bits or more: any two that differ in 14 of the first 60 bits at most meet, by five bands.
LONG = Bands((0, 12, 24, 36, 48), 12, 2)
#: Pairs with a code of 32 bits: any two that differ in 7 bits at most meet.
SHORT = Bands((0, 10, 20), 12, 3)
#: Rows of queries' probes that are broadcast at once.
PROBES = 500_000


def banded_join(kept: DataFrame, part: DataFrame, on: Column, bands: Bands) -> DataFrame:
    """Pairs of kept (…, w0) and part (…, q_w0) that satisfy `on` and agree in a band but for radius bits.

    An equi-join on (band, value): part's rows are probed with every value near theirs, so kept is read
    once and not moved if part is broadcast. A pair that meets in several bands is taken in the first one.
    """
    numbered = [F.struct(F.lit(i).alias("band"), bands.value(F.col("w0"), s).alias("value")) for i, s in enumerate(bands.starts)]
    probes = F.transform(F.array(*map(F.lit, bands.masks())), lambda m: m.cast("long"))
    asked = [F.struct(F.lit(i).alias("q_band"), bands.value(F.col("q_w0"), s).alias("q_value")) for i, s in enumerate(bands.starts)]
    part = part.withColumn("at_", F.explode(F.array(*asked))).withColumn("probe_", F.explode(probes))
    part = F.broadcast(part.select("*", F.col("at_.q_band").alias("q_band"), F.col("at_.q_value").bitwiseXOR(F.col("probe_")).alias("q_value")).drop("at_", "probe_"))
    rows = kept.withColumn("at_", F.explode(F.array(*numbered))).select("*", "at_.band", "at_.value").drop("at_")
    apart = [F.bit_count(bands.value(F.col("w0"), s).bitwiseXOR(bands.value(F.col("q_w0"), s))) > bands.radius for s in bands.starts]
    first = reduce(Column.__and__, [(F.col("band") <= i) | far for i, far in enumerate(apart)])
    return rows.join(part, (F.col("band") == F.col("q_band")) & (F.col("value") == F.col("q_value")) & on & first).drop("band", "value", "q_band", "q_value")


def _banded(kept: DataFrame, queries: DataFrame, keys: tuple[str, ...], on: Column, short: Column, block: int) -> DataFrame:
    """Pairs that meet by LONG, and by SHORT where one of the two is short; short is over both sides' columns."""

    def match(bands: Bands, which: Column) -> DataFrame:
        rows = max(1, min(block, PROBES // (len(bands.starts) * len(bands.masks()))))
        return in_blocks(queries, keys, rows, lambda part: banded_join(kept, part, on & which, bands))

    return match(LONG, ~short).unionByName(match(SHORT, short))


def nphd_nearest(units: DataFrame, queries: DataFrame, limit: int = 100, block: int = 10_000, nearest: str = "exact") -> DataFrame:
    """(query_id, unit_pos, unit_type, asset_key, score, rank): the nearest stored codes of the same type.

    exact compares every query with every stored code of its type; banded those that agree in a band of
    their first word but for a few bits, which all codes near enough do (see LONG and SHORT) and most of
    those somewhat farther. Equals are ordered by key. The rank filter is pushed below the shuffle, so
    each task sends `limit` rows a query at most.
    """
    kept = units.filter(~F.col("unit_type").startswith("INSTANCE_"))
    same = F.col("unit_type") == F.col("q_type")
    if nearest == "banded":
        met = _banded(kept, _asked(queries), ("query_id", "unit_pos"), same, F.least("nbits", "q_nbits") < 64, block)
    else:
        met = in_blocks(_asked(queries), ("query_id", "unit_pos"), block, lambda part: kept.join(part, same))
    near = met.select("query_id", "unit_pos", "unit_type", "asset_key", nphd_score(F.col("nbits"), F.col("q_nbits")).alias("score"))
    order = Window.partitionBy("query_id", "unit_type", "unit_pos").orderBy(F.desc("score"), unsigned_order(F.col("asset_key")))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def segment_nearest(segments: DataFrame, queries: DataFrame, limit: int = 100, oversampling: int = 20, block: int = 10_000, nearest: str = "exact") -> DataFrame:
    """(query_id, sp_type, sp_pos, q_sp, asset_key, sp, offset, size, score, rank): nearest segments by Hamming distance.

    One segment a place is looked at: at the same (asset, offset, size) the first in byte order, which an
    index marks when segments are stored (lead). `limit * 2 * oversampling` segments a query segment are
    kept, as the search of assets needs more segments than assets. nearest is as for nphd_nearest. exact
    compares and ranks each code once, however many queries ask for it.
    """
    kept = (segments if "lead" in segments.columns else with_leads(segments)).filter("lead")
    queries = queries if nearest == "banded" else stored(queries.select("query_id", "sp_pos", "sp_type", "sp"), "queries")
    asked = queries.select("query_id", F.col("sp_type").alias("q_type"), "sp_pos", F.col("sp").alias("q_sp"))
    asked = asked.select("*", *(w.alias(f"q_{n}") for n, w in zip(WORDS, words(F.col("q_sp")), strict=True)))
    bits, most = F.octet_length("sp") * 8, max(1, limit * 2 * oversampling)
    place = (unsigned_order(F.col("asset_key")), "offset", "size")
    if nearest == "banded":
        same = (F.col("sp_type") == F.col("q_type")) & (F.octet_length("sp") == F.octet_length("q_sp"))
        score = 1 - hamming([F.col(w) for w in WORDS], [F.col(f"q_{w}") for w in WORDS]) / bits
        met = _banded(kept, asked, ("query_id", "sp_pos"), same, F.octet_length("sp") < 8, block)
        near = met.select("query_id", "sp_type", "sp_pos", "q_sp", "asset_key", "sp", "offset", "size", score.alias("score"))
        order = Window.partitionBy("query_id", "sp_type", "sp_pos").orderBy(F.desc("score"), *place)
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    ranked = codes_ranked(kept, asked.drop("query_id", "sp_pos"), most, block)
    own = queries.select("query_id", "sp_pos", "sp_type", F.col("sp").alias("q_sp"))
    return ranked.join(own, ["sp_type", "q_sp"]).select("query_id", "sp_type", "sp_pos", "q_sp", "asset_key", "sp", "offset", "size", "score", "rank")


def codes_ranked(kept: DataFrame, asked: DataFrame, most: int, block: int = 10_000) -> DataFrame:
    """(sp_type, q_sp, asset_key, sp, offset, size, score, rank): the `most` nearest leads of each code asked for (q_type, q_sp, q_w0..q_w3)."""
    near = codes_nearest(kept, asked, most, block).withColumn("score", 1 - F.col("apart") / (F.octet_length("sp") * 8)).drop("apart")
    order = Window.partitionBy("sp_type", "q_sp").orderBy(F.desc("score"), unsigned_order(F.col("asset_key")), "offset", "size")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def best_of_codes(segments: DataFrame, asked: DataFrame, limit: int, oversampling: int, threshold: float, block: int = 10_000) -> DataFrame:
    """(sp_type, q_sp, asset_key, sp, offset, size, score): of segment_nearest's exact matches the best of each code and asset, once however many ask.

    asked: queries' rows. Taken where a code's matches are ranked, so they are not moved again.
    """
    kept = (segments if "lead" in segments.columns else with_leads(segments)).filter("lead")
    codes = asked.select(F.col("sp_type").alias("q_type"), F.col("sp").alias("q_sp"))
    codes = codes.select("*", *(w.alias(f"q_{n}") for n, w in zip(WORDS, words(F.col("q_sp")), strict=True)))
    ranked = codes_ranked(kept, codes, max(1, limit * 2 * oversampling), block).filter(F.col("score") >= threshold)
    place = Window.partitionBy("sp_type", "q_sp", "asset_key").orderBy("rank")
    return ranked.withColumn("at", F.row_number().over(place)).filter("at = 1").drop("at", "rank")


#: Bits of a mark for each segment asked for, at least, and of all marks, at most (32 MB, broadcast).
MARK_BITS, MARKS = 16, 1 << 28


def _marked(segments: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """segments without most of those that are not among the n wanted ones (q_type, q_sp): few others go into a shuffle.

    A bit for each hash of a wanted segment, in rows of 512 words of 64 bits. Wanted ones are all kept.
    """
    bits = min(MARKS, 1 << max(15, (MARK_BITS * n).bit_length()))

    def at(*key: Column) -> dict[str, Column]:
        place = F.xxhash64(*key).bitwiseAND(F.lit(bits - 1))
        return {"row_": F.shiftright(place, 15), "word_": F.shiftright(place, 6).bitwiseAND(F.lit(511)).cast("int"), "bit_": place.bitwiseAND(F.lit(63)).cast("int")}

    ones = wanted.select(*(c.alias(name) for name, c in at(F.col("q_type"), F.col("q_sp")).items()))
    ones = ones.select("row_", "word_", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit_")).alias("mask"))
    none = wanted.sparkSession.range(bits >> 6).select(F.shiftright("id", 9).alias("row_"), F.col("id").bitwiseAND(F.lit(511)).cast("int").alias("word_"), F.lit(0).cast("long").alias("mask"))
    words = ones.unionByName(none).groupBy("row_", "word_").agg(F.bit_or("mask").alias("mask"))
    rows = words.groupBy("row_").agg(F.sort_array(F.collect_list(F.struct("word_", "mask")))["mask"].alias("marks"))
    met = segments.withColumns(at(F.col("sp_type"), F.col("sp"))).join(F.broadcast(rows), "row_")
    own = F.call_function("shiftrightunsigned", F.col("marks")[F.col("word_")], F.col("bit_")).bitwiseAND(F.lit(1)) == 1
    return met.filter(own).select(*segments.columns)


def asked_segments(segments: DataFrame, asked: DataFrame, dup_limit: int = 1000, block: int = 10_000) -> DataFrame:
    """(sp_type, sp, asset_key, offset, size, freq): the segments that stored rows of queries ask for, once each, as segment_exact finds them."""
    wanted, n = asked.select(F.col("sp_type").alias("q_type"), F.col("sp").alias("q_sp")).distinct(), asked.count()
    same = (F.col("sp_type") == F.col("q_type")) & (F.col("sp") == F.col("q_sp"))
    rows = segments.select("sp_type", "sp", "asset_key", "offset", "size")
    # Not a semi join where rows are marked: the optimizer would push it below the marks.
    met = rows.join(F.broadcast(wanted), same, "left_semi") if n <= block else _marked(rows, wanted, n).join(wanted, same).drop("q_type", "q_sp")
    equal, key = Window.partitionBy("sp_type", "sp"), unsigned_order(F.col("asset_key"))
    first = met.withColumn("at", F.row_number().over(equal.orderBy(key, "offset", "size"))).filter(F.col("at") <= dup_limit)
    first = first.withColumn("asset", F.dense_rank().over(equal.orderBy(key))).withColumn("freq", F.max("asset").over(equal).cast("long"))
    return stored(first.drop("at", "asset"), "asked-segments")


def segment_exact(segments: DataFrame, queries: DataFrame, dup_limit: int = 1000, block: int = 10_000) -> DataFrame:
    """(query_id, sp_type, sp_pos, sp, asset_key, offset, size, freq): equal segments, the first dup_limit of each in key order.

    Segments are read and ranked once, however many queries ask for them: those asked for are kept, by a
    broadcast of up to `block` rows of queries and by a shuffle of more, cut, stored, and joined to the queries.
    freq: distinct assets among a segment's rows that are left, the same for all who ask for it.
    """
    asked = stored(queries.select("query_id", "sp_pos", "sp_type", "sp"), "queries")
    first = asked_segments(segments, asked, dup_limit, block)
    few = F.broadcast if asked.count() <= block else (lambda frame: frame)
    return first.join(few(asked), ["sp_type", "sp"]).select("query_id", "sp_type", "sp_pos", "sp", "asset_key", "offset", "size", "freq")
