"""Scores of assets from their matches, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.codec import unsigned_order
from simloom.store import stored

#: Digits of a score that count where scores are ranked or held against a threshold.
DIGITS = 9
#: Hashes of pairs of a query and an asset that are broadcast at most.
PAIRS = 1_000_000
#: Frequencies of segments that are broadcast at most.
FREQS = 500_000


def exact_sum(column: Column) -> Column:
    """Sum of doubles as decimals of 15 places: the order in which rows arrive does not change its last bits."""
    return F.sum(column.cast("decimal(38,15)")).cast("double")


def settled(score: Column | str) -> Column:
    """A score as it is ranked: scores that are equal but for rounding errors are ties."""
    return F.round(score, DIGITS)


def best_per_type(matches: DataFrame) -> DataFrame:
    """(query_id, asset_key, unit_type, score): the greatest score over a query's units of a type."""
    return matches.groupBy("query_id", "asset_key", "unit_type").agg(F.max("score").alias("score"))


def confidence(per_type: DataFrame, threshold: float = 0.75, exponent: int = 4) -> DataFrame:
    """(query_id, asset_key, score, types): sum of s^e over sum of s, over the types at or above the threshold.

    Assets without such a type are left out; types maps every matched type, low ones too.
    """
    enough = F.col("score") >= threshold
    s = F.when(enough, F.col("score"))
    grouped = per_type.groupBy("query_id", "asset_key").agg(
        (exact_sum(F.pow(s, F.lit(float(exponent)))) / exact_sum(s)).alias("confidence"),
        F.count(s).alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit_type", "score")))).alias("types"),
    )
    return grouped.filter("n > 0").select("query_id", "asset_key", F.coalesce("confidence", F.lit(0.0)).alias("score"), "types")


def mean_over_queried(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, asset_key, score, types) of graded prefix matches.

    A type's score is the greatest number of matched bits over the greatest number of query bits of
    that type; the asset's is their sum over the number of query units.
    """
    asked = queries.groupBy("query_id", "unit_type").agg(F.max("nbits").alias("q_bits"), F.count("*").alias("n_units"))
    asked = asked.withColumn("n_units", F.sum("n_units").over(Window.partitionBy("query_id")))
    best = matches.groupBy("query_id", "asset_key", "unit_type").agg(F.max("matched_bits").alias("bits"))
    scored = best.join(asked, ["query_id", "unit_type"]).withColumn("score", F.col("bits") / F.col("q_bits"))
    return scored.groupBy("query_id", "asset_key").agg(
        (exact_sum(F.col("score")) / F.max("n_units")).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit_type", "score")))).alias("types")
    )


def idf(freq: Column, total: Column | float) -> Column:
    """ln(1 + N / (1 + df)), 0 for an empty index."""
    total = total if isinstance(total, Column) else F.lit(total)
    return F.when(total <= 0, 0.0).otherwise(F.log(1 + total / (1 + freq)))


def document_frequency(segments: DataFrame, dup_limit: int = 1000) -> DataFrame:
    """(sp_type, sp, freq): distinct assets among the first dup_limit rows of a segment, in key order."""
    order = Window.partitionBy("sp_type", "sp").orderBy(unsigned_order(F.col("asset_key")), "offset", "size")
    scanned = segments.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= dup_limit)
    return scanned.groupBy("sp_type", "sp").agg(F.countDistinct("asset_key").alias("freq"))


def best_segment(matches: DataFrame) -> DataFrame:
    """The best segment of each query segment and asset; equals by place."""
    order = Window.partitionBy("query_id", "sp_type", "sp_pos", "asset_key").orderBy(F.desc("score"), "offset", "size")
    return matches.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def idf_weighted(matches: DataFrame, queries: DataFrame, freqs: DataFrame, total: int, threshold: float = 0.75) -> DataFrame:
    """(query_id, sp_type, asset_key, score, matches, queried, chunks) of nearest segments.

    Segments below the threshold do not count. Score: idf-weighted similarities over the idf of all
    of the query's segments; a matched one is weighed by the stored segment, an unmatched one by its
    own. The unmatched sum is the query's total less its matched segments, so no row is made for
    each query segment and asset.
    """
    best = best_segment(matches.filter(F.col("score") >= threshold))
    freqs = freqs.select(F.col("sp_type").alias("f_type"), F.col("sp").alias("f_sp"), "freq")

    def with_freq(frame: DataFrame, sp: str, name: str) -> DataFrame:
        met = frame.join(freqs, (F.col("sp_type") == F.col("f_type")) & (F.col(sp) == F.col("f_sp")), "left")
        return met.withColumn(name, F.coalesce("freq", F.lit(0))).drop("f_type", "f_sp", "freq")

    asked = with_freq(queries, "sp", "q_freq").withColumn("q_idf", idf(F.col("q_freq"), float(total)))
    totals = asked.groupBy("query_id", "sp_type").agg(exact_sum(F.col("q_idf")).alias("q_total"), F.count("*").alias("queried"))
    best = with_freq(best, "sp", "m_freq").withColumn("m_idf", idf(F.col("m_freq"), float(total)))
    best = best.join(asked.select("query_id", "sp_type", "sp_pos", "q_idf"), ["query_id", "sp_type", "sp_pos"])
    chunk = F.struct("q_sp", F.col("sp").alias("match"), "score", F.col("m_freq").alias("freq"), "offset", "size")
    per = best.groupBy("query_id", "sp_type", "asset_key").agg(
        exact_sum(F.col("m_idf") * F.col("score")).alias("gained"),
        exact_sum(F.col("m_idf") - F.col("q_idf")).alias("change"),
        F.countDistinct("sp_pos").alias("matches"),
        F.sort_array(F.collect_list(chunk)).alias("chunks"),
    )
    per = per.join(totals, ["query_id", "sp_type"])
    whole = F.col("q_total") + F.col("change")
    score = F.when(whole > 0, F.col("gained") / whole).otherwise(0.0)
    return per.select("query_id", "sp_type", "asset_key", score.alias("score"), "matches", "queried", "chunks")


def _idf_parts(asked: DataFrame, freqs: DataFrame, total: int) -> DataFrame:
    """asked's rows with q_idf; freqs (sp_type, sp, freq)."""
    return asked.join(freqs, ["sp_type", "sp"], "left").withColumn("q_idf", idf(F.coalesce("freq", F.lit(0)), float(total))).drop("freq")


def idf_scores(best: DataFrame, asked: DataFrame, freqs: DataFrame, total: int, block: int = 10_000) -> DataFrame:
    """(query_id, sp_type, asset_key, score, matches, queried): the scores of idf_weighted, without chunks.

    best (sp_type, q_sp, asset_key, sp, score, ...): the best segments of match.best_of_codes; asked: queries' rows, freqs:
    (sp_type, sp, freq); all stored. best is moved once, by what is scored, unless queries or frequencies are too many to broadcast.
    """
    small = freqs.count() <= FREQS
    freqs = F.broadcast(freqs) if small else freqs
    own = _idf_parts(asked, freqs, total)
    totals = own.groupBy("query_id", "sp_type").agg(exact_sum(F.col("q_idf")).alias("q_total"), F.count("*").alias("queried"))
    own = own.select("query_id", "sp_type", F.col("sp").alias("q_sp"), "q_idf")
    met = best.select("sp_type", "q_sp", "asset_key", "sp", "score").join(freqs, ["sp_type", "sp"], "left").withColumn("m_idf", idf(F.coalesce("freq", F.lit(0)), float(total)))
    met = met.join(F.broadcast(own) if asked.count() <= block else own, ["sp_type", "q_sp"])
    per = met.groupBy("query_id", "sp_type", "asset_key").agg(
        exact_sum(F.col("m_idf") * F.col("score")).alias("gained"), exact_sum(F.col("m_idf") - F.col("q_idf")).alias("change"), F.count("*").alias("matches")
    )
    whole = F.col("q_total") + F.col("change")
    score = F.when(whole > 0, F.col("gained") / whole).otherwise(0.0)
    return per.join(totals, ["query_id", "sp_type"]).select("query_id", "sp_type", "asset_key", score.alias("score"), "matches", "queried")


def with_near_chunks(scored: DataFrame, best: DataFrame, asked: DataFrame, freqs: DataFrame) -> DataFrame:
    """scored (query_id, sp_type, asset_key, ...) with the chunks that idf_weighted lists, looked up for these rows only."""
    rows = scored.select("query_id", "sp_type", "asset_key").join(asked.select("query_id", "sp_type", F.col("sp").alias("q_sp")), ["query_id", "sp_type"])
    rows = rows.join(best, ["sp_type", "q_sp", "asset_key"]).join(freqs, ["sp_type", "sp"], "left")
    chunk = F.struct("q_sp", F.col("sp").alias("match"), "score", F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "size")
    rows = rows.groupBy("query_id", "sp_type", "asset_key").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    return scored.join(rows, ["query_id", "sp_type", "asset_key"])


def _rare(freq: str = "freq") -> Column:
    """1/df in 22 places: as frequencies lie close together near their cap, differences of 1/df need more places than scores."""
    return F.lit(1).cast("decimal(1,0)") / F.col(freq).cast("decimal(21,0)")


def _covered() -> Column:
    """Coverage by quality, of found, queried, rare (the sum of 1/df), least and most (of df).

    Quality is the mean of 1/df between the least and the most; 1 if these are equal.
    """
    low, high, n = 1 / F.col("most"), 1 / F.col("least"), F.col("found")
    return n / F.col("queried") * F.when(F.col("least") == F.col("most"), 1.0).otherwise((F.col("rare").cast("double") / n - low) / (high - low))


def coverage_quality(matches: DataFrame, queries: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(query_id, sp_type, asset_key, score, matches, queried, chunks) of equal segments.

    coverage: share of the query's segments matched; quality: mean of 1/df, scaled to [0, 1] over
    the asset's matched segments (1 if they are equally frequent). df is counted among the matches,
    unless they bring it (freq).
    """
    asked = queries.groupBy("query_id", "sp_type").agg(F.count("*").alias("queried"))
    if "freq" not in matches.columns:
        matches = matches.join(matches.groupBy("query_id", "sp_type", "sp").agg(F.countDistinct("asset_key").alias("freq")), ["query_id", "sp_type", "sp"])
    # Moved once: both groups below lie within these keys.
    rows = matches.repartition("query_id", "sp_type", "asset_key")
    chunk = F.struct(F.col("sp").alias("q_sp"), F.col("sp").alias("match"), F.lit(1.0).alias("score"), "freq", "offset", "size")
    each = rows.groupBy("query_id", "sp_type", "asset_key", "sp").agg(F.max("freq").alias("freq"), F.count("*").alias("n"), F.collect_list(chunk).alias("chunks"))
    per = each.groupBy("query_id", "sp_type", "asset_key").agg(
        F.count("*").alias("found"),
        F.sum("n").alias("matches"),
        F.sum(_rare()).alias("rare"),
        F.min("freq").alias("least"),
        F.max("freq").alias("most"),
        F.sort_array(F.flatten(F.collect_list("chunks"))).alias("chunks"),
    )
    per = per.join(asked, ["query_id", "sp_type"]).withColumn("score", _covered())
    return per.filter(settled("score") >= threshold).select("query_id", "sp_type", "asset_key", "score", "matches", "queried", "chunks")


def coverage_scores(held: DataFrame, asked: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(query_id, sp_type, asset_key, score, matches, queried): the scores of coverage_quality, with no row for each match.

    held: (sp_type, sp, asset_key, freq), a row an occurrence of a segment asked for; asked: queries' rows; both stored.
    Segments that occur equally often in the same assets are one class, and a query's segments of a class are one
    row: copies share whole classes. As quality is 1 at most, an asset must have `need` of a query's segments, so it has
    one of all but its `need` - 1 most frequent ones. Assets met by these are the only ones whose classes are summed, all of them.
    """
    one = held.repartition("sp_type", "sp").groupBy("sp_type", "sp", "asset_key").agg(F.count("*").alias("n"), F.max("freq").alias("freq"))
    listed = one.groupBy("sp_type", "sp").agg(F.max("freq").alias("freq"), F.sort_array(F.collect_list(F.struct("asset_key", "n"))).alias("assets"))
    # The hash only spares comparisons of lists.
    alike = listed.groupBy("sp_type", "freq", F.xxhash64("assets").alias("hash"), "assets").agg(F.min("sp").alias("class"), F.collect_list("sp").alias("sps"))
    classes = stored(alike.drop("hash"), "segment-classes")
    own = asked.groupBy("query_id", "sp_type", "sp").agg(F.count("*").alias("times"))
    own = own.join(classes.select("sp_type", "freq", "class", F.explode("sps").alias("sp")), ["sp_type", "sp"])
    own = own.groupBy("query_id", "sp_type", "class").agg(F.max("freq").alias("freq"), F.count("*").alias("c"), F.sum("times").alias("times"))
    own = own.join(asked.groupBy("query_id", "sp_type").agg(F.count("*").alias("queried")), ["query_id", "sp_type"])
    need = F.greatest(F.lit(1), F.ceil(F.col("queried") * F.lit(threshold - 10.0 ** (1 - DIGITS))))
    query = Window.partitionBy("query_id", "sp_type")
    before = F.sum("c").over(query.orderBy("freq", "class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    own = stored(own.withColumn("rare", before <= F.sum("c").over(query) - need), "asked-classes")
    met = own.join(classes.select("sp_type", "class", "assets"), ["sp_type", "class"]).withColumn("a", F.explode("assets"))
    met = met.withColumn("asset_key", F.col("a.asset_key")).withColumn("pair", F.xxhash64("query_id", "sp_type", "asset_key"))
    # Where hashes of two pairs are equal, one too many is summed, and held against the threshold like the rest.
    pairs = stored(met.filter("rare").select("pair").distinct(), "pairs")
    met = met.join(F.broadcast(pairs) if pairs.count() <= PAIRS else pairs, "pair", "left_semi")
    per = met.groupBy("query_id", "sp_type", "asset_key").agg(
        F.max("queried").alias("queried"),
        F.sum("c").alias("found"),
        F.sum(F.col("times") * F.col("a.n")).alias("matches"),
        F.sum(_rare() * F.col("c").cast("decimal(12,0)")).alias("rare"),
        F.min("freq").alias("least"),
        F.max("freq").alias("most"),
    )
    per = per.withColumn("score", _covered())
    return per.filter(settled("score") >= threshold).select("query_id", "sp_type", "asset_key", "score", "matches", "queried")


def with_equal_chunks(scored: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """scored (query_id, sp_type, asset_key, ...) with the chunks that coverage_quality lists, looked up for these rows only."""
    chunk = F.struct(F.col("sp").alias("q_sp"), F.col("sp").alias("match"), F.lit(1.0).alias("score"), "freq", "offset", "size")
    rows = scored.select("query_id", "sp_type", "asset_key").join(asked.select("query_id", "sp_type", "sp"), ["query_id", "sp_type"])
    rows = rows.join(held, ["sp_type", "sp", "asset_key"]).groupBy("query_id", "sp_type", "asset_key").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    return scored.join(rows, ["query_id", "sp_type", "asset_key"])


def mean_over_types(per_type: DataFrame) -> DataFrame:
    """(query_id, asset_key, score, types): the mean of the matched segment types' scores; chunks are among the types' details if given."""
    entry = F.struct("sp_type", F.struct(*(c for c in ("score", "matches", "queried", "chunks") if c in per_type.columns)).alias("detail"))
    return per_type.groupBy("query_id", "asset_key").agg((exact_sum(F.col("score")) / F.count("*")).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("types"))


def top_k(scored: DataFrame, k: int, partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query, those equal in DIGITS digits by key, with their rank."""
    order = Window.partitionBy(*partition).orderBy(settled("score").desc(), unsigned_order(F.col("asset_key")))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def without_self(scored: DataFrame, own: DataFrame) -> DataFrame:
    """Rows whose asset is not the query's own. own: (query_id, self_key), null for queries that are no asset."""
    met = scored.join(own.select("query_id", "self_key"), "query_id", "left")
    return met.filter(~F.col("asset_key").eqNullSafe(F.col("self_key"))).drop("self_key")
