"""Hash text and hash values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space a sender may leave around a value (ASCII and Unicode blanks).
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Hex digits of each hash.
HEX_LENGTHS = {"crc32": 8, "md5": 32, "sha1": 40, "sha256": 64, "blake3": 64}
REQUIRED = ("crc32", "md5", "sha1")
OPTIONAL = ("sha256", "blake3")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def clean_hash(c: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def is_hex(c: Column, digits: int) -> Column:
    return (F.length(c) == digits) & c.rlike(f"^[0-9a-f]{{{digits}}}$")


def crc32_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(c)), 8, "0"))
