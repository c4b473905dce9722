"""Perceptual hashes as signed 64-bit numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of equal kind throughout: blank pictures.
_BLANK = r"^([0-9a-f])\1{15}$"


def read_hash(text: Column) -> Column:
    """A perceptual hash as a signed 64-bit number: 1 to 16 hex digits of either case; a leading 0x, blanks and hyphens
    do not count. Null for other texts and for hashes of sixteen equal digits."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s-]", ""), "^0x", "")
    full = F.lpad(digits, 16, "0")
    high = F.conv(F.substring(full, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(full, 9, 8), 16, 10).cast("bigint")
    return F.when(digits.rlike("^[0-9a-f]{1,16}$") & ~full.rlike(_BLANK), F.shiftleft(high, 32).bitwiseOR(low))


def write_hash(h: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def prefix_bucket(h: Column, bits: int = 16) -> Column:
    """The top bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits)
