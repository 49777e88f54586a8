"""Keyed hashes (HMAC-SHA-256) from the engine's own functions, and contexts signed with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block of SHA-256, and the pads of the inner and outer hash.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def xored(hexed: Column, pad: int) -> Column:
    """The hex digits of a block, each byte exclusive-or ``pad``: 16 digits for either half of a byte."""
    digits = "0123456789ABCDEF"
    high, low = ("".join(digits[d ^ half] for d in range(16)) for half in (pad >> 4, pad & 15))
    half = lambda i, k, to: F.translate(F.substring(hexed, 2 * i + k, F.lit(1)), digits, to)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.concat(half(i, 1, high), half(i, 2, low))), "")


def hmac_sha256(key: Column, message: Column) -> Column:
    """The HMAC-SHA-256 of a message (text or bytes) as lower-case hex; null if either is null.

    A key over 64 bytes is hashed first, a shorter one filled with zeros."""
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > BLOCK, F.upper(F.sha2(raw, 256))).otherwise(F.hex(raw))
    padded = F.rpad(short, 2 * BLOCK, "0")
    inner = F.sha2(F.concat(F.unhex(xored(padded, INNER)), message.cast("binary")), 256)
    mac = F.sha2(F.concat(F.unhex(xored(padded, OUTER)), F.unhex(inner)), 256)
    return F.when(key.isNotNull() & message.isNotNull(), mac)


def canonical_context(*fields: Column) -> Column:
    """Fields as one text in which no two lists of fields look alike: each with its length in bytes."""
    return F.concat(*(F.concat(F.coalesce(F.octet_length(c.cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c.cast("string"), F.lit("")), F.lit("\n")) for c in fields))


def verified_contexts(contexts: DataFrame, keys: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """``contexts`` with ``state``: valid, unknown_key, bad_signature, expired or not_yet_valid.

    ``contexts`` have key_id, ``fields``, issued_at, expires_at and signature, over the canonical text
    of key_id, the fields and both times; ``keys`` have key_id and secret, one row a key."""
    known = keys.select("key_id", F.col("secret").alias("_secret"))
    rows = contexts.join(known, "key_id", "left")
    text = canonical_context(F.col("key_id"), *(F.col(c) for c in fields), F.unix_micros("issued_at"), F.unix_micros("expires_at"))
    right = F.coalesce(F.lower("signature") == hmac_sha256(F.col("_secret"), text), F.lit(False))
    state = F.when(F.col("_secret").isNull(), "unknown_key").when(~right, "bad_signature")
    state = state.when(F.coalesce(F.col("expires_at") <= now, F.lit(True)), "expired").when(F.coalesce(F.col("issued_at") > now, F.lit(True)), "not_yet_valid").otherwise("valid")
    return rows.withColumn("state", state).drop("_secret")
