"""Content codes as Python bytes, for functions that work on whole Arrow batches.

The same rules as the Column functions in `codec`, which the tests hold against these. Malformed
input gives None, never an error.
"""

from __future__ import annotations

import base64
import re

from simloom.functions import codec

_PLAIN = re.compile(f"[{codec.BASE32}]+")
_VALUE = str.maketrans(codec.BASE32, codec.DIGITS)
_MULTIHASH = re.compile("[0-9a-fA-F]{68}")
_VARIABLE = re.compile(r"\{([/.]?)(iscc_id|iscc_code|datahash)\}")


def decode(text: str | None) -> bytes | None:
    plain = (text or "").removeprefix(codec.PREFIX)
    if not _PLAIN.fullmatch(plain):
        return None
    n = len(plain) * 5 // 8
    return (int(plain.translate(_VALUE), 32) >> (len(plain) * 5 - n * 8)).to_bytes(n, "big")


def canonical(digest: bytes) -> str:
    return codec.PREFIX + base64.b32encode(digest).decode().rstrip("=")


def unit_type(digest: bytes | None) -> str | None:
    if digest is None or len(digest) < 2:
        return None
    main, sub, version = digest[0] >> 4, digest[0] & 15, digest[1] >> 4
    if main >= len(codec.MAIN_TYPES):
        return None
    names = {codec.SEMANTIC: codec.MEDIA, codec.CONTENT: codec.MEDIA, codec.CODE: codec.CODE_SUBTYPES, codec.ID: codec.REALMS}.get(main, ("NONE",))
    return f"{codec.MAIN_TYPES[main]}_{names[sub]}_V{version}" if sub < len(names) else None


def _code_units(digest: bytes) -> list[bytes]:
    sub, version, mask, body = digest[0] & 15, digest[1] & 0xF0, digest[1] & 15, digest[2:]
    if len(body) < (32 if sub == codec.WIDE else 8 * (mask & 7).bit_count() + 16):
        return []
    if sub == codec.WIDE:
        return [bytes([main << 4, version | 3]) + body[16 * i : 16 * i + 16] for i, main in enumerate((codec.DATA, codec.INSTANCE))]
    present = [(main << 4 | (sub if main != codec.META else 0)) for bit, main in ((4, codec.META), (2, codec.SEMANTIC), (1, codec.CONTENT)) if mask & bit]
    units = [bytes([head, version | 1]) + body[8 * i : 8 * i + 8] for i, head in enumerate(present)]
    return [*units, bytes([codec.DATA << 4, version | 1]) + body[-16:-8], bytes([codec.INSTANCE << 4, version | 1]) + body[-8:]]


def decompose(digest: bytes | None) -> list[bytes]:
    """Units of a composite code or of a sequence of units."""
    rest, out = digest or b"", []
    for _ in range(max(1, len(rest) // 6)):  # a unit has six bytes at least
        if len(rest) < 2:
            break
        if rest[0] >> 4 == codec.CODE:
            return out + _code_units(rest)
        size = 2 + ((rest[1] & 15) + 1) * 4
        out.append(rest[:size])
        rest = rest[size:]
    return out


def longest_per_type(units: list[bytes]) -> list[bytes]:
    """The longest unit of each type (the first of equals), in order of first sight."""
    best: dict[str, bytes] = {}
    for unit in units:
        kind = unit_type(unit)
        if kind not in best or len(unit) > len(best[kind]):
            best[kind] = unit  # a key keeps its place
    return list(best.values())


def id_error(text: str | None) -> str | None:
    """The first rule an id breaks."""
    digest = decode(text)
    rules = (
        text is not None and text.startswith(codec.PREFIX),
        digest is not None,
        digest is not None and len(digest) == 10,
        digest is not None and digest[:1] and digest[0] >> 4 == codec.ID,
        digest is not None and digest[1:2] and digest[1] & 15 == 0,
    )
    return next((name for name, holds in zip(codec.ID_ERRORS, rules, strict=False) if not holds), None)


def id_key(text: str) -> int:
    return int.from_bytes(decode(text)[2:10], "big", signed=True)


def id_realm(text: str) -> int:
    return decode(text)[0] & 15


def instance_of_datahash(datahash: str | None) -> bytes | None:
    """256-bit instance unit of a multihash in hex."""
    if datahash is None or not _MULTIHASH.fullmatch(datahash):
        return None
    return bytes([codec.INSTANCE << 4, 7]) + bytes.fromhex(datahash[4:])


def expand_gateway(template: str, iscc_id: str, iscc_code: str, datahash: str) -> str:
    """URI template whose variables, with / or . before the name or nothing, are replaced; codes lose their prefix."""
    values = {"iscc_id": iscc_id.removeprefix(codec.PREFIX).lower(), "iscc_code": iscc_code.removeprefix(codec.PREFIX).lower(), "datahash": datahash}
    return _VARIABLE.sub(lambda m: m[1] + values[m[2]], template)
