"""Secret scans with multipart credential linking.

Strong spans (assignments of secrets, access key ids, long hex runs) are reported as they are.
Weak candidates are parts of a credential that say little alone: login or client identifiers,
mixed-case tokens that look like keys, and endpoints. They are reported only where the
complementary part co-occurs in their scope, `reach` code points to either side:

    ident     needs a secret (assign, hex or a token)
    token     needs an identifier (access or ident)
    endpoint  needs both

Linking is an interval join: every part is put in the position bins it touches (bins are no wider
than the reach), parts of one role in one bin are reduced to their least start and greatest end,
and each candidate looks at the bins its scope touches. As a scope is wider than a bin, it ends in
different bins, where the least start or greatest end decides exactly; so a bin full of parts costs
one row a role, and no pairs are made. DataFrame functions only.

Nulls and empty texts have no spans; repeated rows are documents of their own; a null id is kept.
Weak candidates that overlap a strong span are left out, as are identifiers inside tokens. Spans of
two strong kinds at one place are all reported, in the order the kinds are listed. Texts and runs of
any length are scanned whole. An empty table gives an empty result. Columns other than id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import Kind, overlaps_any, per_document, positions, scan

_NAME = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"({_NAME}){_SET}([A-Za-z0-9+/_.=-]+)"

STRONG = [
    Kind("assign", ASSIGN),
    Kind("access", "AKIA[A-Z0-9]+", "AKIA"),
    Kind("hex", "[0-9a-f]{24,}+", "[0-9a-f]{24}"),
]
WEAK = [
    Kind("ident", rf"(?i:client_?id|account_?id|access_?key_?id|app_?id|tenant_?id|user_?name|login|user){_SET}[A-Za-z0-9][A-Za-z0-9@._+-]{{2,}}+"),
    Kind("token", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_-])", "[A-Za-z0-9+/_-]{24}"),
    Kind("endpoint", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?[A-Za-z0-9/_.~%?&=#-]*", "://"),
]
BASE = [k.name for k in STRONG]
REACH = 200


def _role(kind: Column) -> Column:
    return F.when(kind.isin("access", "ident"), "id").when(kind == "endpoint", "place").otherwise("secret")


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match counts: the length rules of the strong kinds."""
    return (
        F.when(kind == "assign", F.char_length(F.regexp_extract(value, ASSIGN, 2)) >= 6)
        .when(kind == "access", F.char_length(value) >= 20)
        .otherwise(F.lit(True))
    )


def linked(parts: DataFrame, weak: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of weak (row_, order, kind, start, end) with complementary parts within reach.

    parts: the same columns, strong and weak. Distances are between the ends of spans.
    """
    own = parts.select("row_", _role(F.col("kind")).alias("role"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("bin"))
    bins = own.groupBy("row_", "bin", "role").agg(F.min("start").alias("least"), F.max("end").alias("most"))
    lo, hi = F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach
    scopes = weak.select("row_", "order", "kind", "start", "end", F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach))).alias("bin"))
    least = F.greatest(F.col("least"), F.col("bin") * reach)
    most = F.least(F.col("most"), (F.col("bin") + 1) * reach)
    near = scopes.join(bins, ["row_", "bin"]).filter((least <= hi) & (most >= F.col("start") - reach))
    seen = near.groupBy("row_", "order", "kind", "start", "end").agg(*(F.max(F.col("role") == r).alias(f"has_{r}") for r in ("id", "secret")))
    kind = F.col("kind")
    enough = F.when(kind == "ident", F.col("has_secret")).when(kind == "token", F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    return seen.filter(enough).select("row_", "order", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Columns: id, n_assign, n_access, n_hex, base, spans (kind:start:end, comma-joined)."""
    scanned = scan(docs, id_col, text_col, STRONG + WEAK)
    found = positions(scanned).filter(_holds(F.col("kind"), F.col("value")))
    strong = F.col("kind").isin(BASE)
    found = found.withColumn("covered", overlaps_any(strong)).filter(strong | ~F.col("covered")).select("row_", "order", "kind", "start", "end")
    spans = found.filter(strong).unionByName(linked(found, found.filter(~strong), reach))
    return per_document(scanned, spans, BASE, id_col)
