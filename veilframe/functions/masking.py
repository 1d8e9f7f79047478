"""Narrow column transforms: mask (T1), null-out (T2), salted hash (T5), HMAC.

Every function maps ``Column -> Column`` with built-in expressions only, so a
profile of many transforms fuses into one code-generated projection. Null in
gives null out. Non-string inputs are cast to string first, which mirrors the
reference's ``str(val)`` for integers and strings.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

# Fixed values of HMAC-SHA256 (RFC 2104): block size and pad bytes.
HMAC_BLOCK_SIZE = 64
HMAC_IPAD_BYTE = 0x36
HMAC_OPAD_BYTE = 0x5C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    return _col(c).cast(StringType())


def mask(c, keep_last: int = 4, mask_char: str = "*") -> Column:
    """Replace all but the last ``keep_last`` characters with ``mask_char``.

    Strings no longer than ``keep_last`` are masked completely; the output
    keeps the input length. ``keep_last=0`` masks everything.
    """
    if keep_last < 0:
        raise ValueError("keep_last must be >= 0")
    if len(mask_char) != 1:
        raise ValueError("mask_char must be one character")
    s = as_text(c)
    n = F.length(s)
    k = F.lit(keep_last)
    ch = F.lit(mask_char)
    return F.when(
        n <= k, F.repeat(ch, n)
    ).otherwise(F.concat(F.repeat(ch, n - k), F.substring(s, -keep_last, keep_last) if keep_last > 0 else F.lit("")))


def null_out(c, dtype: DataType | None = None) -> Column:
    """Replace every value with NULL, keeping the column type when given."""
    return F.lit(None).cast(dtype or StringType())


def salted_hash(c, salt: str = "") -> Column:
    """Hex SHA-256 of ``salt || str(value)`` (UTF-8)."""
    return F.sha2(F.concat(F.lit(salt), as_text(c)), 256)


def _hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > HMAC_BLOCK_SIZE:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK_SIZE, b"\x00")
    ipad = bytes(b ^ HMAC_IPAD_BYTE for b in key)
    opad = bytes(b ^ HMAC_OPAD_BYTE for b in key)
    return ipad, opad


def hmac_sha256_raw(c, key: bytes) -> Column:
    """HMAC-SHA256 of the UTF-8 text of ``c`` as a 32-byte binary column.

    The pads are folded into literals on the driver, so each row costs two
    SHA-256 calls inside codegen and no Python.
    """
    if not key:
        raise ValueError("hmac requires a non-empty key")
    ipad, opad = _hmac_pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), as_text(c).cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256))


def hmac_pseudonym(c, key: bytes, out_len: int = 12) -> Column:
    """URL-safe base64 of HMAC-SHA256, padding stripped, first ``out_len`` chars."""
    if out_len < 1:
        raise ValueError("out_len must be >= 1")
    # '=' padding only ends the 44-char encoding, so cutting first and then
    # mapping '+/' to '-_' on the short head gives the same text, cheaper.
    head = F.substring(F.base64(hmac_sha256_raw(c, key)), 1, out_len)
    out = F.replace(F.replace(head, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    return F.replace(out, F.lit("="), F.lit("")) if out_len >= 44 else out
