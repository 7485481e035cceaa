"""Signatures and encodings, composed of built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text or binary column, in lower-case hexadecimal."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    inner, outer = bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def signature_is_valid(body: Column, header: Column, secret: str) -> Column:
    """Whether a header ``sha256=<hex>`` signs the body; a missing header doesn't."""
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(body, secret)), F.lit(False))


def from_base64(text: Column) -> Column:
    """Decoded text; characters that base64 hasn't, as line breaks, are skipped."""
    return F.unbase64(F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")).cast("string")
