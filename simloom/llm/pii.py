"""Personal data: base patterns plus bootstrapped contextual extraction.

Base spans (e-mail, IP address, payment card, phone) are seeds. The words before a seed make
lexical patterns; patterns and instances form a bipartite graph that is scored in rounds:

* a pattern's score for a kind is the mean score of the distinct values seen in it (a seed value
  counts 1 for its own kind, any other value its score so far), if `support` values of the kind or
  more stand behind it;
* an unseen value's score for a kind is the greatest score of the patterns it occurs in, if it has
  the loose shape of that kind.

After `rounds` rounds at least, and as many more as add a pattern or make one confident, the
patterns of at least `confidence` are kept, and every loosely shaped candidate in such a pattern
that overlaps no base span is reported as ctx_<kind>. Candidates are tokens without blanks, and
groups of digits joined by a blank (or hyphen, dot, slash, brackets) each. A group of a loose shape
takes the place of the tokens in it; its context is what stands before the whole group. Counts cover all
documents; they are summed in map tasks before the shuffle, so a common context costs a row a
value and task. DataFrame functions only.

Nulls and empty texts have no spans; repeated rows are documents of their own but add no support
(values are counted once a pattern); a null id is kept. Spans of several kinds at one place are all
reported, in the order the kinds are listed. Texts of any length are scanned whole; a context reaches
CONTEXT characters back. An empty table gives an empty result. Columns other than id and text are
not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise
from .spans import Kind, overlaps_any, per_document, positions, scan

_LOCAL = "A-Za-z0-9._%+-"
KINDS = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{10}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
#: Tokens with a digit or an at sign: what contexts are asked about.
TOKEN = Kind("token", r"(?<![^\x00-\x20])[^\x00-\x20@0-9]*+[@0-9][^\x00-\x20]*+", "[@0-9]")
#: Groups of digits, joined as in the card and phone patterns; those with a blank are candidates.
GROUP = Kind("group", r"(?<![\p{L}\p{N}@+(._/#-])[A-Z]{0,4}+\(?+[0-9]++(?![\p{L}@_])\)?+(?:[\x20./-]?+\(?+[0-9]++(?![\p{L}@_])\)?+)++", r"[0-9]\)?\x20\(?[0-9]")
BASE = [k.name for k in KINDS]
#: Loose shapes: what may be an unseen identifier of the kind.
SHAPES = {
    "email": r"^[^@]{2,64}@[^@]{2,64}$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,5}(?:\.[0-9]{1,5}){3,5}$",
    "card": r"^[A-Z]{0,4}[0-9](?:[-/]?[0-9]){8,24}$",
    "phone": r"^\(?[0-9][0-9()./-]{5,18}[0-9]$",
}
GROUP_SHAPES = {
    "card": r"^[A-Z]{0,4}[0-9](?:[\x20/-]?[0-9]){8,24}$",
    "phone": r"^\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}\)?$",
}
#: Characters before a span that its context is taken from.
CONTEXT = 64
#: Values of a kind that must stand behind a pattern, and the score from which it is used.
SUPPORT = 3
CONFIDENCE = 0.8
#: Rounds of scoring at least.
ROUNDS = 2

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """The rules a match must pass to be a base span."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _contexts(before: Column) -> Column:
    """The last one and the last two words before a span, lower case; none where it follows another span."""
    words = F.filter(F.split(F.lower(before), r"[^\p{L}]+"), lambda w: w != "")
    n = F.size(words)
    one = F.when(n >= 1, F.element_at(words, -1))
    two = F.when(n >= 3, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))
    return F.array_compact(F.array(one, two))


def _confident(seeds: DataFrame, unseen: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(context, kind) of high-confidence patterns. seeds: (context, kind, value); unseen: (context, value, kinds)."""
    seeds = seeds.distinct().withColumn("score", F.lit(1.0))
    seeded = seeds.select("value").distinct().withColumn("known", F.lit(True))
    unseen = unseen.distinct().join(seeded, "value", "left").filter("known is null").drop("known")
    totals = seeds.select("context", "value").union(unseen.select("context", "value")).distinct().groupBy("context").agg(F.count("*").alias("n"))
    shaped = unseen.select("context", "value", F.explode("kinds").alias("kind"))
    scored = seeds
    before, done = (0, 0), 0
    while True:
        sums = scored.groupBy("context", "kind").agg(F.sum("score").alias("s"), F.count(F.when(F.col("score") >= confidence, 1)).alias("behind"))
        patterns = sums.filter(F.col("behind") >= support).join(totals, "context").select("context", "kind", (F.col("s") / F.col("n")).alias("p"))
        patterns = materialise(patterns, "pii-patterns")
        # Scores only rise, so patterns are only added; equal counts are equal sets.
        now = tuple(patterns.agg(F.count("*"), F.count(F.when(F.col("p") >= confidence, 1))).first())
        done += 1
        if done >= rounds and now[0] <= before[0] and now[1] <= before[1]:
            return patterns.filter(F.col("p") >= confidence).select("context", "kind")
        before = now
        reached = shaped.join(bounded(patterns), ["context", "kind"]).groupBy("kind", "value").agg(F.max("p").alias("score"))
        more = shaped.join(reached, ["kind", "value"]).select("context", "kind", "value", "score")
        scored = seeds.unionByName(more)


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """Columns: id, n_email, n_ip, n_card, n_phone, base, spans (kind:start:end, comma-joined)."""
    scanned = scan(docs, id_col, text_col, [*KINDS, TOKEN, GROUP], CONTEXT)
    found = positions(scanned)
    token, group = F.col("kind") == TOKEN.name, F.col("kind") == GROUP.name
    candidate = token | group
    # A token's span leaves out the punctuation around it.
    lead = F.when(token, F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}@+(\[]*+", 0))).otherwise(0)
    core = F.when(token, F.regexp_extract("value", r"^[^\p{L}\p{N}@+(\[]*+(.*?)[^\p{L}\p{N})]*$", 1)).otherwise(F.col("value"))
    found = found.filter(F.when(group, F.contains("value", F.lit(" "))).otherwise(token | holds(F.col("kind"), F.col("value"))))
    found = found.withColumn("core", core).withColumn("start", F.col("start") + lead)
    found = found.withColumn("end", F.col("start") + F.char_length("core")).withColumn("covered", overlaps_any(~candidate))
    shaped = [F.when(token & F.col("core").rlike(p), F.lit(k)) for k, p in SHAPES.items()] + [F.when(group & F.col("core").rlike(p), F.lit(k)) for k, p in GROUP_SHAPES.items()]
    found = found.withColumn("kinds", F.array_compact(F.array(*shaped)))
    found = found.filter(~candidate | (~F.col("covered") & (F.col("core") != ""))).filter(~group | (F.size("kinds") > 0))
    found = found.withColumn("grouped", overlaps_any(group)).filter(~token | ~F.col("grouped"))
    # A group's gap may hold tokens, which end contexts.
    before = F.when(group, F.regexp_replace("before", r"(?s)^.*[@0-9][^\x00-\x20]*+", "")).otherwise(F.col("before"))
    found = materialise(found.select("row_", "order", "kind", "start", "end", F.col("core").alias("value"), _contexts(before).alias("contexts"), "kinds"), "pii-mentions")
    mentions = found.select("row_", "order", "kind", "start", "end", "value", "kinds", F.explode("contexts").alias("context"))
    patterns = _confident(mentions.filter(~candidate).select("context", "kind", "value"), mentions.filter(candidate).select("context", "value", "kinds"), support, confidence, rounds)
    shaped = mentions.filter(candidate).select("row_", "start", "end", "context", F.explode("kinds").alias("kind"))
    orders = F.create_map(*(x for i, k in enumerate(SHAPES) for x in (F.lit(k), F.lit(len(KINDS) + i))))
    new = shaped.join(bounded(materialise(patterns, "pii-confident")), ["context", "kind"]).select("row_", orders[F.col("kind")].alias("order"), F.concat(F.lit("ctx_"), "kind").alias("kind"), "start", "end").distinct()
    spans = found.filter(~candidate).select("row_", "order", "kind", "start", "end").unionByName(new)
    return per_document(scanned, spans, BASE, id_col)
