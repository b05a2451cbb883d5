"""Content codes as Column expressions: base32, headers, unit types, decomposition, ids, pointers.

A digest is a two-byte header (nibbles: main type, subtype, version, length) and a body. All
functions take and return Columns and stay inside Catalyst; malformed input gives null, never an
error, so they can stand in front of a filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "ISCC:"
#: RFC 4648 base32 and the digits conv() uses for base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Main types and subtypes in order of their numbers.
MAIN_TYPES = ("META", "SEMANTIC", "CONTENT", "DATA", "INSTANCE", "ISCC", "ID", "FLAKE")
MEDIA = ("TEXT", "IMAGE", "AUDIO", "VIDEO", "MIXED")
CODE_SUBTYPES = (*MEDIA, "SUM", "NONE", "WIDE")
REALMS = ("REALM_0", "REALM_1")
META, SEMANTIC, CONTENT, DATA, INSTANCE, CODE, ID = range(7)
SUM, NONE, WIDE = 5, 6, 7


def bind(column: Column, use) -> Column:
    """use(column), with the column computed once however often use mentions it."""
    return F.transform(F.array(column), use)[0]


# ---- base32 -----------------------------------------------------------------------------------


def strip_prefix(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PREFIX}", "")


def decode_base32(text: Column) -> Column:
    """Digest of base32 text (prefix allowed, no padding); null if a character is not base32."""

    def decoded(plain: Column) -> Column:
        groups = F.ceil(F.length(plain) / 8).cast("int")

        def five_bytes(i: Column) -> Column:
            digits = F.translate(F.rpad(F.substring(plain, i * 8 + 1, F.lit(8)), 8, "A"), BASE32, DIGITS)
            return F.lpad(F.conv(digits, 32, 16), 10, "0")

        hexed = F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), five_bytes), "")
        n = F.floor(F.length(plain) * 5 / 8).cast("int")
        return F.when(plain.rlike(f"^[{BASE32}]+$"), F.unhex(F.substring(hexed, F.lit(1), n * 2)))

    return bind(strip_prefix(text), decoded)


def encode_base32(digest: Column) -> Column:
    def encoded(hexed: Column) -> Column:
        groups = F.ceil(F.length(hexed) / 10).cast("int")

        def eight_digits(i: Column) -> Column:
            return F.lpad(F.conv(F.rpad(F.substring(hexed, i * 10 + 1, F.lit(10)), 10, "0"), 16, 32), 8, "0")

        digits = F.translate(F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), eight_digits), ""), DIGITS, BASE32)
        return F.when(F.length(hexed) > 0, F.substring(digits, F.lit(1), F.ceil(F.length(hexed) * 4 / 5).cast("int")))

    return bind(F.hex(digest), encoded)


def canonical(digest: Column) -> Column:
    return F.concat(F.lit(PREFIX), encode_base32(digest))


# ---- headers ----------------------------------------------------------------------------------


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(digest, i, 1)), 16, 10).cast("int")


def main_type(digest: Column) -> Column:
    return F.shiftright(_byte(digest, 1), 4)


def subtype(digest: Column) -> Column:
    return _byte(digest, 1).bitwiseAND(15)


def version(digest: Column) -> Column:
    return F.shiftright(_byte(digest, 2), 4)


def length_field(digest: Column) -> Column:
    return _byte(digest, 2).bitwiseAND(15)


def body(digest: Column) -> Column:
    return F.substring(digest, 3, 1_000_000)


def nbits(digest: Column) -> Column:
    return (F.octet_length(digest) - 2) * 8


def _name(names: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i)


def unit_type(digest: Column) -> Column:
    """MAIN_SUB_Vn, e.g. CONTENT_TEXT_V0; null if a number has no name."""

    def named(h: Column) -> Column:
        nibble = [F.conv(F.substring(h, i, 1), 16, 10).cast("int") for i in (1, 2, 3)]
        main, sub, vers = nibble
        sub_name = (
            F.when(main.isin(SEMANTIC, CONTENT), _name(MEDIA, sub))
            .when(main == CODE, _name(CODE_SUBTYPES, sub))
            .when(main == ID, _name(REALMS, sub))
            .when(sub == 0, F.lit("NONE"))
        )
        name = F.concat(_name(MAIN_TYPES, main), F.lit("_"), sub_name, F.lit("_V"), vers.cast("string"))
        return F.when(F.length(h) == 4, name)

    return bind(F.hex(F.substring(digest, 1, 2)), named)


def header(main: Column | int, sub: Column | int, vers: Column | int, length: Column | int) -> Column:
    """The two header bytes from four nibbles."""
    nibbles = [x if isinstance(x, Column) else F.lit(x) for x in (main, sub, vers, length)]
    return F.unhex(F.concat(*(F.hex(x.cast("int")) for x in nibbles)))


# ---- words for Hamming distances ----------------------------------------------------------------


def words(unit_body: Column) -> list[Column]:
    """Four 64-bit words of a body of up to 256 bits, zeros after its end."""
    hexed = F.rpad(F.hex(unit_body), 64, "0")
    return [F.conv(F.substring(hexed, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]


# ---- sequences and composite codes --------------------------------------------------------------


def _code_units(digest: Column) -> Column:
    """Units of one composite code, as digests; none if its body is too short for them."""
    b, vers, mask, sub = body(digest), version(digest), length_field(digest), subtype(digest)

    def unit(main: int, st: Column | int, length: int, data: Column) -> Column:
        return F.concat(header(main, st, vers, length), data)

    has = {META: mask.bitwiseAND(4) > 0, SEMANTIC: mask.bitwiseAND(2) > 0, CONTENT: mask.bitwiseAND(1) > 0}
    at = {META: F.lit(0), SEMANTIC: has[META].cast("int"), CONTENT: has[META].cast("int") + has[SEMANTIC].cast("int")}
    dynamic = [F.when(has[m], unit(m, 0 if m == META else sub, 1, F.substring(b, at[m] * 8 + 1, F.lit(8)))) for m in (META, SEMANTIC, CONTENT)]
    end = F.octet_length(b)
    static = [unit(DATA, 0, 1, F.substring(b, end - 15, F.lit(8))), unit(INSTANCE, 0, 1, F.substring(b, end - 7, F.lit(8)))]
    wide = F.array(unit(DATA, 0, 3, F.substring(b, 1, 16)), unit(INSTANCE, 0, 3, F.substring(b, 17, 16)))
    least = F.when(sub == WIDE, 32).otherwise(F.bit_count(mask.bitwiseAND(7)) * 8 + 16)
    units = F.when(sub == WIDE, wide).otherwise(F.array_compact(F.array(*dynamic, *static)))
    return F.when(end >= least, units).otherwise(F.array().cast("array<binary>"))


def decompose(digest: Column) -> Column:
    """Unit digests of a composite code or of a sequence of unit digests."""
    empty = F.array().cast("array<binary>")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        size = F.lit(2) + (length_field(rest) + 1) * 4
        more, composite = F.octet_length(rest) >= 2, main_type(rest) == CODE
        out = F.when(more & composite, F.concat(state["out"], _code_units(rest))).when(more, F.concat(state["out"], F.array(F.substring(rest, F.lit(1), size)))).otherwise(state["out"])
        left = F.when(more & ~composite, F.substring(rest, size + 1, F.lit(1_000_000))).otherwise(F.lit(b""))
        return F.struct(left.alias("rest"), out.alias("out"))

    start = F.struct(F.coalesce(digest, F.lit(b"")).alias("rest"), empty.alias("out"))
    # A unit has six bytes at least, which bounds the steps.
    most = F.greatest(F.lit(1), F.floor(F.coalesce(F.octet_length(digest), F.lit(0)) / 6).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["out"])


def compose(units: Column) -> Column:
    """Composite digest (wide form where it applies) of an array of unit digests.

    Null without a data and an instance unit, or if semantic and content units differ in subtype.
    Of several units of a main type the first counts.
    """

    def composed(picked: Column) -> Column:
        pick = {m: picked[f"u{m}"] for m in (META, SEMANTIC, CONTENT, DATA, INSTANCE)}
        data, instance = pick[DATA], pick[INSTANCE]
        dynamic = [pick[m] for m in (META, SEMANTIC, CONTENT)]
        bare = F.coalesce(*dynamic).isNull()
        wide = bare & (nbits(data) >= 128) & (nbits(instance) >= 128)
        sub = F.coalesce(subtype(pick[SEMANTIC]), subtype(pick[CONTENT]), F.when(bare, F.lit(SUM)).otherwise(F.lit(NONE)))
        agree = pick[SEMANTIC].isNull() | pick[CONTENT].isNull() | (subtype(pick[SEMANTIC]) == subtype(pick[CONTENT]))
        mask = sum((F.when(u.isNotNull(), 4 >> i).otherwise(0) for i, u in enumerate(dynamic)), F.lit(0))
        cut = [F.coalesce(F.substring(body(u), 1, 8), F.lit(b"")) for u in (*dynamic, data, instance)]
        usual = F.concat(header(CODE, sub, 0, mask), *cut)
        broad = F.concat(header(CODE, WIDE, 0, 0), F.substring(body(data), 1, 16), F.substring(body(instance), 1, 16))
        return F.when(data.isNotNull() & instance.isNotNull() & agree, F.when(wide, broad).otherwise(usual))

    def picked(us: Column) -> Column:
        def first_of(main: int) -> Column:
            return F.get(F.filter(us, lambda u: main_type(u) == main), F.lit(0))

        return F.struct(*(first_of(m).alias(f"u{m}") for m in (META, SEMANTIC, CONTENT, DATA, INSTANCE)))

    return bind(bind(units, picked), composed)


# ---- ids ----------------------------------------------------------------------------------------


def key_of_body(id_body: Column) -> Column:
    """64-bit key of eight body bytes, as a signed long."""
    return F.conv(F.hex(id_body), 16, -10).cast("long")


def id_key(iscc_id: Column) -> Column:
    return key_of_body(body(decode_base32(iscc_id)))


def id_realm(iscc_id: Column) -> Column:
    return subtype(decode_base32(iscc_id))


def id_from_key(key: Column, realm: Column | int) -> Column:
    """Canonical id of a signed 64-bit key; null unless the realm is 0 or 1."""
    realm = realm if isinstance(realm, Column) else F.lit(realm)
    digest = F.concat(header(ID, realm, 1, 0), F.unhex(F.lpad(F.hex(key), 16, "0")))
    return F.when(realm.isin(0, 1), canonical(digest))


def unsigned_order(key: Column) -> Column:
    """Sorts signed keys as the unsigned numbers they stand for."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def new_id_keys(base_micros: int, row: Column, hub: int = 0) -> Column:
    """Keys of fresh ids: a microsecond a row after base_micros, and the hub in the low 12 bits."""
    return F.shiftleft(F.lit(base_micros).cast("long") + row.cast("long"), 12).bitwiseOR(F.lit(hub).cast("long"))


#: Error codes of id_error, in the order they are tested.
ID_ERRORS = ("no_prefix", "bad_base32", "bad_length", "not_an_id", "bad_length_field", "wrong_realm")


def id_error(iscc_id: Column, realm: Column | int | None = None) -> Column:
    """The first rule an id breaks, or null."""

    def broken(digest: Column) -> Column:
        error = (
            F.when(iscc_id.isNull() | ~iscc_id.startswith(PREFIX), "no_prefix")
            .when(digest.isNull(), "bad_base32")
            .when(F.octet_length(digest) != 10, "bad_length")
            .when(main_type(digest) != ID, "not_an_id")
            .when(length_field(digest) != 0, "bad_length_field")
        )
        return error if realm is None else error.when(subtype(digest) != realm, "wrong_realm")

    return bind(decode_base32(iscc_id), broken)


def index_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z][a-z0-9]*$"), F.lit(False))


def index_name_of(repo: Column) -> Column:
    """Index name from a repository id: last path part, letters and digits, no leading iscc, 32 at most; null if none."""
    name = F.regexp_replace(F.lower(F.regexp_extract(repo, "([^/]*)$", 1)), "[^a-z0-9]", "")
    name = F.left(F.when(name.startswith("iscc") & (F.length(name) > 4), F.substring(name, 5, 1000)).otherwise(name), F.lit(32))
    return F.when(name.rlike("^[a-z]"), name)


# ---- chunk pointers and simprints ----------------------------------------------------------------


def pack_pointer(key: Column, offset: Column, size: Column) -> Column:
    """Sixteen bytes: key, offset, size (32 bits each, big endian); null out of range."""
    fits = offset.between(0, 2**32 - 1) & size.between(0, 2**32 - 1)
    return F.when(fits, F.unhex(F.concat(F.lpad(F.hex(key), 16, "0"), F.lpad(F.hex(offset), 8, "0"), F.lpad(F.hex(size), 8, "0"))))


def unpack_pointer(pointer: Column) -> Column:
    hexed = F.hex(pointer)
    return F.when(
        F.octet_length(pointer) == 16,
        F.struct(
            F.conv(F.substring(hexed, 1, 16), 16, -10).cast("long").alias("asset_key"),
            F.conv(F.substring(hexed, 17, 8), 16, 10).cast("long").alias("offset"),
            F.conv(F.substring(hexed, 25, 8), 16, 10).cast("long").alias("size"),
        ),
    )


def decode_simprint(text: Column) -> Column:
    """Bytes of URL-safe base64 without padding; null if a character does not belong."""
    plain = F.regexp_replace(text, "=+$", "")
    good = plain.rlike("^[A-Za-z0-9+/_-]+$") & (F.length(plain) % 4 != 1)
    return F.when(good, F.unbase64(F.rpad(F.translate(plain, "-_", "+/"), (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))))


def encode_simprint(data: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(data), "[=\\r\\n]", ""), "+/", "-_")


def simprints_of_features(features: Column, bits: int | None = None) -> Column:
    """features[] to array<struct<sp_type, simprint, offset, size>>, in order.

    Types are upper-cased; the three lists are zipped to the shortest; with `bits` simprints are
    cut, and those that are shorter or cannot be decoded are dropped.
    """

    def of(feature: Column) -> Column:
        main, sub = F.upper(F.coalesce(feature["maintype"], F.lit(""))), F.upper(F.coalesce(feature["subtype"], F.lit("")))
        sp_type = F.concat(main, F.lit("_"), sub, F.lit("_V"), F.coalesce(feature["version"].cast("string"), F.lit("0")))
        n = F.least(*(F.coalesce(F.size(feature[c]), F.lit(0)) for c in ("simprints", "offsets", "sizes")))

        def one(i: Column) -> Column:
            text = F.get(feature["simprints"], i)
            data = decode_simprint(text)
            shown = text if bits is None else F.when(F.octet_length(data) >= bits // 8, encode_simprint(F.substring(data, 1, bits // 8)))
            return F.struct(sp_type.alias("sp_type"), shown.alias("simprint"), F.get(feature["offsets"], i).cast("long").alias("offset"), F.get(feature["sizes"], i).cast("long").alias("size"))

        empty = F.array().cast("array<struct<sp_type:string,simprint:string,offset:bigint,size:bigint>>")
        listed = F.when((main != "") & (sub != "") & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), one))
        return F.coalesce(listed, empty)

    return F.filter(F.flatten(F.transform(features, of)), lambda x: x["simprint"].isNotNull())


# ---- log records ----------------------------------------------------------------------------------


def expand_gateway(template: Column, iscc_id: Column, iscc_code: Column, datahash: Column) -> Column:
    """URI template with {v}, {/v} and {.v} for the three variables; codes are lower-cased without prefix.

    The template is cut before and after braces; a piece that is a variable gives its value, others stay.
    """
    value = F.create_map(F.lit("iscc_id"), F.lower(strip_prefix(iscc_id)), F.lit("iscc_code"), F.lower(strip_prefix(iscc_code)), F.lit("datahash"), datahash)
    variable = r"^\{([/.]?)(iscc_id|iscc_code|datahash)\}$"

    def filled(piece: Column) -> Column:
        return F.when(piece.rlike(variable), F.concat(F.regexp_extract(piece, variable, 1), value[F.regexp_extract(piece, variable, 2)])).otherwise(piece)

    return F.array_join(F.transform(F.split(template, r"(?=\{)|(?<=\})", -1), filled), "")


def instance_of_datahash(datahash: Column) -> Column:
    """256-bit instance unit digest of a multihash in hex (its first two bytes go); null if it is not one."""
    good = datahash.rlike("^[0-9a-fA-F]{68}$")
    return F.when(good, F.concat(header(INSTANCE, 0, 0, 7), F.unhex(F.substring(datahash, 5, 64))))


def longest_per_type(units: Column) -> Column:
    """Of an array of unit digests the longest of each type (the first of equals), in order of first sight."""

    def entry(u: Column, i: Column) -> Column:
        return F.struct(unit_type(u).alias("t"), F.octet_length(u).alias("n"), (-i).alias("first"), u.alias("u"))

    def chosen(entries: Column) -> Column:
        def of(t: Column) -> Column:
            return F.array_max(F.transform(F.filter(entries, lambda e: e["t"] == t), lambda e: F.struct(e["n"].alias("n"), e["first"].alias("first"), e["u"].alias("u"))))["u"]

        return F.transform(F.array_distinct(F.transform(entries, lambda e: e["t"])), of)

    return bind(F.transform(units, entry), chosen)
