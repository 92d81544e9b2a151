"""Scalar functions over columns: digests, encryption and element-wise vector arithmetic, all built in."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column, bits: int = 256) -> Column:
    """SHA-2 digest in hex."""
    return F.sha2(c, bits)


def fingerprint(*cs: Column) -> Column:
    """64-bit hash of the columns."""
    return F.xxhash64(*cs)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a hash (long) of a text's UTF-8 bytes."""
    raw = F.hex(F.encode(c, "UTF-8"))
    return _fnv(F.transform(F.filter(F.sequence(F.lit(0), F.length(raw).cast("int") - 1, F.lit(1)), lambda i: i % 2 == 0), lambda i: F.conv(F.substring(raw, i + 1, F.lit(2)), 16, 10).cast("long")), F.length(raw) > 0)


def fnv1a_long(c: Column) -> Column:
    """32-bit FNV-1a hash (long) of a whole number's eight bytes, the lowest first."""
    return _fnv(F.array(*[F.shiftright(c.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)]), F.lit(True))


def _fnv(octets: Column, some: Column) -> Column:
    start = F.lit(2166136261).cast("long")  # offset basis and prime: fixed values
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(some, F.aggregate(octets, start, step)).when(~some, start)


def encrypt(c: Column, key: str) -> Column:
    """AES-GCM with a random nonce; key of 16, 24 or 32 characters."""
    return F.aes_encrypt(c, F.lit(key), F.lit("GCM"))


def decrypt(c: Column, key: str) -> Column:
    return F.aes_decrypt(c, F.lit(key), F.lit("GCM")).cast("string")


def vector_add(a: Column, b: Column) -> Column:
    """Element-wise sum; null where the shorter vector ends."""
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_mul(a: Column, b: Column) -> Column:
    """Element-wise product; null where the shorter vector ends."""
    return F.zip_with(a, b, lambda x, y: x * y)
