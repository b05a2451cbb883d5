"""Search: query preparation, the three modes over whole codes, and segment search.

An index is a set of frames (see simloom.model): assets, units, segments. Queries come as
(query_id, iscc_id, iscc_code, units) with any of the last three set; an id wins over the rest.
Metadata is joined after the top-k, so only results are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions import codec
from simloom.model import Options
from simloom.operators import match, score
from simloom.store import stored


def get_assets(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups: (iscc_id, error, found columns) for each id; error names the broken rule or not_found."""
    asked = ids.select(F.col("iscc_id").alias("asked_id")).withColumn("key_", codec.id_key(F.col("asked_id"))).withColumn("error_", codec.id_error(F.col("asked_id")))
    met = asked.join(assets, asked["key_"] == assets["asset_key"], "left")
    error = F.coalesce(F.col("error_"), F.when(F.col("asset_key").isNull(), F.lit("not_found")))
    return met.select(F.col("asked_id").alias("iscc_id"), error.alias("error"), "asset_key", "iscc_code", "units", "metadata")


def expand_by_id(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """Queries by id take the stored code and units (segments are not stored with assets); not_found flags missing ones."""
    stored = assets.select(F.col("iscc_id").alias("s_id"), F.col("asset_key").alias("self_key"), F.col("iscc_code").alias("s_code"), F.col("units").alias("s_units"))
    met = queries.join(stored, queries["iscc_id"] == stored["s_id"], "left")
    by_id = F.col("iscc_id").isNotNull()
    return met.select(
        "query_id",
        "iscc_id",
        F.when(by_id, F.col("s_code")).otherwise(F.col("iscc_code")).alias("iscc_code"),
        F.when(by_id, F.col("s_units")).otherwise(F.col("units")).alias("units"),
        "self_key",
        (by_id & F.col("self_key").isNull()).alias("not_found"),
    )


def normalise(queries: DataFrame) -> DataFrame:
    """Fill in what is missing: units from the code, or the code from units where they make one.

    valid is false where there is neither.
    """
    has_units, has_code = F.coalesce(F.size("units") > 0, F.lit(False)), F.col("iscc_code").isNotNull()
    from_code = F.transform(codec.decompose(codec.decode_base32(F.col("iscc_code"))), codec.canonical)
    from_units = codec.canonical(codec.compose(F.transform("units", codec.decode_base32)))
    units = F.when(has_units, F.col("units")).when(has_code, from_code)
    code = F.when(has_code, F.col("iscc_code")).when(has_units, from_units)
    return queries.withColumns({"units": units, "iscc_code": code, "valid": has_units | has_code})


def units_of(frame: DataFrame, key: str, units: str = "units") -> DataFrame:
    """(key, unit_pos, unit_type, nbits, w0..w3, body) of an array of canonical unit strings; undecodable ones go."""
    flat = frame.select(key, F.posexplode(units).alias("unit_pos", "unit")).withColumn("digest", codec.decode_base32(F.col("unit")))
    flat = flat.withColumn("unit_type", codec.unit_type(F.col("digest"))).filter("unit_type is not null")
    flat = flat.withColumn("body", codec.body(F.col("digest"))).withColumn("nbits", codec.nbits(F.col("digest")))
    return flat.select(key, "unit_pos", "unit_type", "nbits", *(w.alias(f"w{i}") for i, w in enumerate(codec.words(F.col("body")))), "body")


def segments_of(frame: DataFrame, key: str, simprints: str = "simprints") -> DataFrame:
    """(key, sp_type, sp, offset, size) of entries' segments, each once; those that are no base64 go."""
    flat = frame.select(key, F.explode(simprints).alias("s")).select(key, "s.sp_type", codec.decode_simprint(F.col("s.simprint")).alias("sp"), "s.offset", "s.size")
    return flat.filter("sp is not null and sp_type is not null").distinct()


def query_segments_of(queries: DataFrame) -> DataFrame:
    """(query_id, sp_pos, sp_type, sp) of (query_id, simprints map<type, array<text>>)."""
    flat = queries.select("query_id", F.explode("simprints").alias("sp_type", "listed")).select("query_id", "sp_type", F.posexplode("listed").alias("sp_pos", "text"))
    return flat.select("query_id", F.col("sp_pos").cast("long").alias("sp_pos"), "sp_type", codec.decode_simprint(F.col("text")).alias("sp")).filter("sp is not null")


def shown(results: DataFrame) -> DataFrame:
    """Chunk matches with the segments in their chunks as text: (query, match, score, freq, offset, size)."""

    def chunk(c: Column) -> Column:
        text = [codec.encode_simprint(c[old]).alias(new) for old, new in (("q_sp", "query"), ("match", "match"))]
        return F.struct(*text, *(c[n].alias(n) for n in ("score", "freq", "offset", "size")))

    def detail(_: Column, d: Column) -> Column:
        return F.struct(*(d[n].alias(n) for n in ("score", "matches", "queried")), F.transform(d["chunks"], chunk).alias("chunks"))

    return results.withColumn("types", F.transform_values("types", detail))


def with_source(results: DataFrame) -> DataFrame:
    """Results with the URL that their metadata names."""
    return results.withColumn("source", F.get_json_object("metadata", "$.source"))


def search_exact(assets: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """Assets with the query's composite code: (query_id, asset_key, score 1, types, rank)."""
    own = queries.filter("iscc_code is not null")
    found = match.exact_code_join(assets, own, options.query_block)
    types = own.select("query_id", F.array_sort(F.array_distinct(F.transform("units", lambda u: codec.unit_type(codec.decode_base32(u))))).alias("names"))
    types = types.select("query_id", F.map_from_arrays("names", F.transform("names", lambda _: F.lit(1.0))).alias("types"))
    found = score.without_self(found, queries) if "self_key" in queries.columns else found
    return score.top_k(found.join(types, "query_id", "left"), options.limit)


def search_prefix(units: DataFrame, query_units: DataFrame, own: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Graded prefix search: (query_id, asset_key, score, types, rank)."""
    found = score.mean_over_queried(match.prefix_join_graded(units, query_units, options.query_block), query_units)
    return score.top_k(score.without_self(found, own) if own is not None else found, options.limit)


def search_similarity(units: DataFrame, query_units: DataFrame, own: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Instance prefixes and nearest codes of other types: (query_id, asset_key, score, types, rank).

    As candidates are cut to `limit` a query unit before the query's own asset is taken out, a
    search by id may return one result less.
    """
    columns = ("query_id", "asset_key", "unit_type", "score")
    instance = match.prefix_join_binary(units, query_units.filter(F.col("unit_type").startswith("INSTANCE_")), options.query_block)
    near = match.nphd_nearest(units, query_units.filter(~F.col("unit_type").startswith("INSTANCE_")), options.limit, options.query_block, options.nearest)
    found = score.confidence(score.best_per_type(instance.select(*columns).unionByName(near.select(*columns))), options.threshold_units, options.exponent)
    return score.top_k(score.without_self(found, own) if own is not None else found, options.limit)


def search_segments(segments: DataFrame, queries: DataFrame, total_assets: int, exact: bool = False, options: Options = Options(), chunks: bool = True) -> DataFrame:
    """Segment search: (query_id, asset_key, score, types, rank).

    Each segment type is searched for twice the limit; the mean over types is ranked. A threshold
    bounds single segments in the approximate mode, whole type scores in the exact one. The chunks
    behind scores are looked up after the top-k, and left out of types unless asked for.
    """
    asked = stored(queries.select("query_id", "sp_pos", "sp_type", "sp"), "queries")

    def best(per: DataFrame) -> DataFrame:
        return score.top_k(per, 2 * options.limit, ("query_id", "sp_type")).drop("rank")

    def frequencies(near: DataFrame) -> DataFrame:
        """Of the segments that were asked for or met only."""
        met = near.select("sp_type", "sp").union(asked.select("sp_type", "sp")).distinct()
        return score.document_frequency(segments.join(met, ["sp_type", "sp"], "left_semi"), options.dup_limit)

    if exact:
        held = match.asked_segments(segments, asked, options.dup_limit, options.query_block)
        per = best(score.coverage_scores(held, asked, options.threshold_simprints))
        if chunks:
            per = score.with_equal_chunks(stored(per, "scores"), held, asked)
    elif options.nearest == "exact":
        near = stored(match.best_of_codes(segments, asked, options.limit, options.oversampling, options.threshold_simprints, options.query_block), "near-segments")
        freqs = stored(frequencies(near), "frequencies")
        per = best(score.idf_scores(near, asked, freqs, total_assets, options.query_block))
        if chunks:
            per = score.with_near_chunks(stored(per, "scores"), near, asked, freqs)
    else:
        near = stored(match.segment_nearest(segments, asked, options.limit, options.oversampling, options.query_block, options.nearest), "near-segments")
        per = best(score.idf_weighted(near, asked, frequencies(near), total_assets, options.threshold_simprints))
        per = per if chunks else per.drop("chunks")
    return score.top_k(score.mean_over_types(per), options.limit)


def with_metadata(results: DataFrame, assets: DataFrame) -> DataFrame:
    """Results with iscc_id and metadata of their assets; null where the asset is gone."""
    return results.join(assets.select("asset_key", "iscc_id", "metadata"), "asset_key", "left")


def search(assets: DataFrame, units: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """The whole path in one mode: expand ids, normalise, match, score, rank, look up metadata."""
    asked = stored(normalise(expand_by_id(queries, assets)).filter("valid"), "asked")
    if options.mode == "exact":
        found = search_exact(assets, asked, options)
    else:
        run = search_prefix if options.mode == "prefix" else search_similarity
        found = run(units, units_of(asked, "query_id"), asked.select("query_id", "self_key"), options)
    return with_metadata(found, assets)
