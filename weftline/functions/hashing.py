"""Identifiers and draws from hashes, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, digits: int = 16) -> Column:
    """Uniform in [0, 1) from the first ``digits`` hex digits of SHA-256: 16 for a full draw, 8 for a short one."""
    whole = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, digits), 16, 10).cast("decimal(20,0)").cast("double")
    return whole / F.lit(float(16**digits))


def seeded(seed: int, *parts: Column, separator: str = ":") -> Column:
    """Key of a draw: the seed and the parts."""
    return F.concat_ws(separator, F.lit(str(seed)), *(p.cast("string") for p in parts))


def short_digest(value: Column, length: int) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, length)


def fitted_id(base: Column, suffix: Column, most: int = 128) -> Column:
    """``base:suffix``, or where that is too long ``<start of base>:h<16 hex of the base's SHA-256>:suffix``; an error where the suffix leaves no room."""
    whole = F.concat(base, F.lit(":"), suffix)
    tail = F.concat(F.lit(":h"), short_digest(base, 16), F.lit(":"), suffix)
    room = F.lit(most) - F.length(tail)
    cut = F.when(room >= 1, F.concat(F.substr(base, F.lit(1), room), tail)).otherwise(F.raise_error(F.concat(F.lit("the suffix is too long: "), suffix)))
    return F.when(F.length(whole) <= most, whole).otherwise(cut)


def set_digest(values: Column) -> Column:
    """Digest of a group's values, whatever their order: an aggregate."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(values.cast("string")))).cast("binary"), 256)


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex digits."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def export_key(secret: str, export_id: str) -> bytes:
    """The key of one export's pseudonyms; the secret itself never enters a plan."""
    import hmac as keyed

    return keyed.new(secret.encode(), export_id.encode(), hashlib.sha256).digest()


def pseudonym(kind: str, value: Column, key: bytes | None) -> Column:
    """Keyed pseudonym ``kind-<16 hex>``, the start of the HMAC of ``kind:value``; without a key the value itself."""
    if key is None:
        return value.cast("string")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{kind}-"), F.substring(hmac(key, F.concat(F.lit(f"{kind}:"), value.cast("string"))), 1, 16)))


def canonical_digest(*fields: Column, length: int = 64) -> Column:
    """Digest of named fields whatever their order: JSON of the struct with its names sorted; nulls are left out."""
    return short_digest(F.to_json(F.sort_array(F.array(*(F.to_json(F.struct(f)) for f in fields)))), length)


def run_id(version: Column, session: Column, digest: Column, started: Column) -> Column:
    """``run-`` and 16 hex digits of all four."""
    return F.concat(F.lit("run-"), short_digest(F.concat_ws("|", version, session.cast("string"), digest, started.cast("string")), 16))
