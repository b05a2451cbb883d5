"""Document fingerprints: spot signatures.

At every anchor (a common word) the next `chain` content words within `reach` words, anchors
skipped, make a signature; the set of a document's signature hashes, sorted, is its fingerprint.
At the end of a text a chain may be shorter. A text with words but no anchor has one signature,
its words; one without words, its characters; an empty or null text has none.

Likeness is the Jaccard index of two fingerprints; two empty ones are alike (1), an empty one and
another are not (0). `near_duplicates` gives the components of the links between fingerprints whose
likeness is a threshold or more, exactly:

1. Equal fingerprints are one node, so copies cost one.
2. Signatures are ordered by rarity: those of few nodes by hash, then the frequent ones by how many
   nodes hold them. Partners share a signature of their prefixes in this order.
3. Every node is compared with the node of least id among those it shares most prefix signatures
   with; groups of near copies come together here, at one comparison a node.
4. Across components, nodes that share a rare prefix signature are paired: they are partitioned by
   set length, so that partners are in the same or the next partition, lengths and positions prune
   pairs that cannot reach the threshold, and the rest is compared. Such groups are small.
5. Partners that share no rare signature share frequent ones alone. Nodes that agree in their
   frequent signatures and in length are one class, and only classes go on, level by level, as long
   as that leaves at most half as many; the last level is paired by its frequent prefix signatures.
So a frequent signature never makes all pairs of its holders.

`with_next` gives each document its successor in ascending id. Ids are cut at quantiles into
ranges; the first document of a range is sent to the range before it too, so one shuffle and a
window inside each range are enough, and no task sees all rows. Ids are whole numbers and need not
be unique: ties are ordered by text, nulls come first. Texts of any length are read whole. Repeated
rows are documents of their own. Empty tables give empty results. Columns that are not asked for
are not looked at, whatever their names. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise, tidied
from .ngram_join import FEWER, FREQUENT, apart, classes_of, close, components, need, star_pairs, unwound

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an and of to in is that it was for on are with as this be at by from or have not but had his they which you were her all she there would their we him been has when who will more no if out so "
    "der die das und den dem des ein eine von zu mit sich auf für ist im nicht auch es an als bei nach wie aus er sie aber vor durch "
    "le la les de des du un une et est en que qui dans pour sur au avec pas par ce il ne se plus ou son "
    "el los las del y que en un una por con para su al lo como más o pero sus este entre cuando muy sin sobre ser"
)
CHAIN = 2
REACH = 8
RANGE_ROWS = 2000
MAX_RANGES = 20_000

_WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def signatures(text: Column, anchors: tuple[str, ...] | None = None, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct signature hashes (array<bigint>)."""
    common = sorted(set(ANCHORS.split() if anchors is None else anchors))
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(whole), _WORD_BREAK), lambda w: w != "")

    def of(w: Column) -> Column:
        def spot(x: Column, i: Column) -> Column:
            content = F.filter(F.slice(w, i + 2, reach), lambda y: ~y.isin(common))
            return F.when(x.isin(common), F.xxhash64(x, F.slice(content, 1, chain)))

        spots = F.array_compact(F.transform(w, spot))
        fallback = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).when(whole != "", F.array(F.xxhash64(whole))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.array(spots), lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(fallback))[0]

    # One-element arrays bind the words and the signatures once each.
    return F.transform(F.array(words), of)[0]


def fingerprint(sigs: Column) -> Column:
    """The signatures as a string: sixteen hex digits each."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct signatures."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def edited_text(text: Column, following: Column) -> Column:
    """text whose last half (rounded down) is replaced by as many first characters of following, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds <= key, less one (0 at least), by binary search."""
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    n, steps = len(bounds), len(bounds).bit_length()

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.element_at(table, middle + 1) <= key
        inside = s["lo"] < s["hi"]
        return F.struct(F.when(inside & right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & ~right, middle).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step)
    return F.greatest(F.coalesce(found["lo"] - 1, F.lit(0)), F.lit(0))


def with_next(docs: DataFrame, id_col: str, text_col: str, columns: list[str], range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """docs with next_<c> for each of columns, of the following document (of the first, after the last).

    The id is an integer column.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("k")).agg(F.count("*").alias("n"), F.count("k").alias("ids"), F.min("k").alias("least")).first()
    n = min(max_ranges, seen["n"] // range_rows + 1)
    bounds: list[int] = []
    if seen["ids"]:
        cuts = [i / n for i in range(1, n)]
        at = docs.select(F.col(id_col).cast("long").alias("k")).agg(F.percentile_approx("k", cuts, max(10_000, 20 * n)).alias("b")).first()["b"] if cuts else []
        bounds = sorted({seen["least"], *at})
    key = F.col(id_col).cast("long")
    own = _range_of(key, bounds) if bounds else F.lit(0)
    last = max(len(bounds) - 1, 0)
    # The first document of all follows the last one; with null ids it is one of these.
    is_first = key.isNull() if seen["ids"] < seen["n"] else key == F.lit(seen["least"])
    # A range begins at its bound; the first range has none before it.
    starts = (F.col("__next_range") > 0) & (key == F.element_at(F.split(F.lit(",".join(map(str, bounds)) or "0"), ",").cast("array<bigint>"), F.col("__next_range") + 1))
    copies = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("stand_in"), F.col("__next_range").alias("range")),
            F.when(F.coalesce(starts, F.lit(False)), F.struct(F.lit(1).alias("stand_in"), (F.col("__next_range") - 1).alias("range"))),
            F.when(F.coalesce(is_first, F.lit(False)), F.struct(F.lit(2).alias("stand_in"), F.lit(last).alias("range"))),
        )
    )
    rows = docs.withColumn("__next_range", own).withColumn("__next_copy", F.explode(copies))
    order = Window.partitionBy("__next_copy.range").orderBy(F.col("__next_copy.stand_in"), key.asc_nulls_first(), F.col(text_col).asc_nulls_first())
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return rows.filter("__next_copy.stand_in = 0").drop("__next_range", "__next_copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, n_chars, edited_text, sigs, edited_sigs, near_edited, near_next)."""
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    rows = rows.withColumn("sigs_", signatures(F.col("text_"), **options))
    rows = with_next(rows, "id_", "text_", ["text_", "sigs_"])
    rows = rows.withColumn("edited_", edited_text(F.col("text_"), F.col("next_text_")))
    rows = rows.withColumn("edited_sigs_", signatures(F.col("edited_"), **options))
    return rows.select(
        F.col("id_").alias(id_col),
        F.char_length("text_").cast("long").alias("n_chars"),
        F.col("edited_").alias("edited_text"),
        F.col("sigs_").alias("sigs"),
        F.col("edited_sigs_").alias("edited_sigs"),
        likeness(F.col("sigs_"), F.col("edited_sigs_")).alias("near_edited"),
        likeness(F.col("sigs_"), F.col("next_sigs_")).alias("near_next"),
    )


def _partition(n: Column, threshold: float) -> Column:
    """Number of the range of lengths n is in; ranges span a factor of 1 / threshold."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def _by_rarity(items: DataFrame, percent: int, frequent: int) -> DataFrame:
    """items (id, c, n, set) with len, prefix (its rare signatures) and, where the prefix goes on among frequent ones, hot, hot_prefix.

    Signatures are counted among the items. n is the size of the whole set of which set may be a part.
    """
    every = items.select("id", "n", F.explode("set").alias("token"))
    counts = every.groupBy("token").agg(F.count("*").alias("often")).filter(F.col("often") > frequent)
    counts = bounded(materialise(counts, "spot-frequent"))
    held = every.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("held"))
    none = F.array().cast("array<bigint>")
    late = F.coalesce(F.col("held.token"), none)
    rows = items.join(held, "id", "left").withColumns({"late": late, "cold": F.array_except("set", late)})
    p = (F.size("set") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    hot = F.size("cold") < p
    rows = rows.select(
        "id",
        "c",
        "n",
        F.size("set").alias("len"),
        F.when(p > 0, F.slice("cold", F.lit(1), F.greatest(p, F.lit(0)))).otherwise(none).alias("prefix"),
        F.when(hot, F.array_sort("late")).otherwise(none).alias("hot"),
        F.when(hot, F.slice("late", F.lit(1), F.greatest(p - F.size("cold"), F.lit(0)))).otherwise(none).alias("hot_prefix"),
    )
    return materialise(rows, "spot-parts")


def _candidates(posts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) across components that share a token of posts (token, id, c, n, len, at) and may reach the threshold there."""
    percent = round(threshold * 100)
    posts = posts.withColumn("part", _partition(F.col("n"), threshold))
    low, high = posts.alias("l"), posts.withColumn("part", F.explode(F.array("part", F.col("part") - 1))).alias("r")
    smaller = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id")))
    first = F.least(F.col("l.len") - F.col("l.at"), F.col("r.len") - F.col("r.at")) >= need(F.col("l.n"), F.col("r.n"), percent)
    on = (F.col("l.part") == F.col("r.part")) & (F.col("l.token") == F.col("r.token")) & apart("l.c", "r.c") & smaller & close("l.n", "r.n", percent) & first
    return low.join(high, on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _alike(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets share enough."""
    left, right = (items.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(F.size(F.array_intersect("set_a", "set_b")) >= need(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _levels(items: DataFrame, threshold: float, frequent: int) -> DataFrame:
    """Links (a, b) that put together all partners across components among items (id, c, n, set), a stored table."""
    percent, levels = round(threshold * 100), []
    while True:
        parts = _by_rarity(items, percent, frequent)
        posts = parts.select("id", "c", "n", "len", F.posexplode("prefix").alias("at", "token"))
        links = materialise(_alike(materialise(_candidates(posts, threshold), "spot-pairs"), items, percent), "spot-links")
        members, classes = classes_of(parts, percent)
        levels.append((links, members))
        items = classes.select(F.col("class").alias("id"), "c", "n", "set", "hot_prefix")
        n, stood_for = classes.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
        if n <= 1 or n > FEWER * stood_for or n == stood_for:
            break
    links = None
    if n > 1:
        posts = items.select("id", "c", "n", F.size("set").alias("len"), F.posexplode("hot_prefix").alias("at", "token"))
        links = materialise(_alike(materialise(_candidates(posts, threshold), "spot-pairs"), items, percent), "spot-links")
    return unwound(levels, links)


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", sigs_col: str = "sigs", threshold: float = 0.75, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_signatures, class_id): the least id among the rows whose fingerprints links of at least threshold lead to.

    Rows of one fingerprint are in one class, empty ones too; an empty one and another are not linked. Rows with
    a null id have no class. Rows that share an id are each in their own fingerprint's class.
    """
    spark, percent = prints.sparkSession, round(threshold * 100)
    key = ("n", "h1", "h2")
    own = prints.select(F.col(id_col).alias("id"), F.col(sigs_col).alias("set"))
    own = own.select("id", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("h1"), F.xxhash64(F.reverse("set"), F.lit(7)).alias("h2"), "set")
    with tidied(spark, "spot-rows", "spot-classes"):
        rows = materialise(own.select("id", *key), "spot-rows")
        sets = own.filter("id is not null").groupBy(*key).agg(F.min("id").alias("id"), F.first("set").alias("set"))
        # A node is a fingerprint, whatever the ids of its rows.
        sets = materialise(sets.withColumn("node", F.xxhash64(*key)), "spot-sets")
        nodes = sets.filter("n > 0").select(F.col("node").alias("id"), F.col("node").alias("c"), "n", "set")
        parts = _by_rarity(nodes, percent, frequent)
        posts = parts.select("id", "n", F.explode(F.concat("prefix", "hot_prefix")).alias("token"))
        leads = posts.groupBy("token").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1")
        posts = posts.join(leads.select("token", F.col("lead.id").alias("lead_id"), F.col("lead.n").alias("lead_n")), "token")
        stars = materialise(star_pairs(posts, percent), "spot-stars")
        comps = components(materialise(_alike(stars, nodes, percent), "spot-links"))
        known = nodes.drop("c").join(bounded(comps), "id", "left").select("id", F.coalesce("component", "id").alias("c"), "n", "set")
        links = _levels(materialise(known, "spot-known"), threshold, frequent)
        star_links = comps.select(F.col("component").alias("a"), F.col("id").alias("b")).filter("a <> b")
        found = components(links.unionByName(star_links))
        classes = sets.drop("set").join(bounded(found.withColumnRenamed("id", "node")), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = classes.groupBy("component").agg(F.min("id").alias("class_id"))
        classes = materialise(classes.join(least, "component").select(*key, "class_id"), "spot-classes")
    out = rows.join(bounded(classes), list(key), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_signatures"), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))
