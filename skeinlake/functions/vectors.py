"""Vectors as arrays of numbers. Sums are in double; every expression runs in the JVM but for the half-precision cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of differing lengths, empty ones and those of length 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalise(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, let(n, lambda m: F.transform(a, lambda x: x / m))).otherwise(F.transform(a, lambda x: x.cast("double")))


def half(a: Column) -> Column:
    """Rounded to half precision: 11 significant bits, subnormal below 2^-14. Beyond the range it is infinite."""

    def one(x: Column) -> Column:
        v = x.cast("double")
        e = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)).cast("double")
        step = F.pow(F.lit(2.0), e - 10)
        r = F.bround(v / step, 0) * step
        return F.when(v == 0, 0.0).when(F.abs(r) >= 65520, F.signum(v) * F.lit(float("inf"))).otherwise(r)

    return F.transform(a, one)


def bits(a: Column) -> Column:
    """Signs of up to 64 values as one long: bit i is set where value i is positive."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def packed_bits(a: Column, size: int) -> Column:
    """Signs of ``size`` values as longs of 64 bits."""
    return F.array(*(bits(F.slice(a, i + 1, 64)) for i in range(0, size, 64)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_code(c: Column) -> Column:
    """A hash of up to 16 hex digits as a long; null if it is none."""
    return F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(c, 16, -10).cast("long"))


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes of equal length; -1 for differing lengths, which match nothing."""
    return F.when(F.length(a) != F.length(b), -1).when(a == "", 0).otherwise(hamming(hex_code(a), hex_code(b)))


def format_vector(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes, as a long."""

    def run(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        byte = lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
        return F.aggregate(at, F.lit(2166136261).cast("long"), lambda s, i: (s.bitwiseXOR(byte(i)) * 16777619) % 4294967296)

    return let(F.hex(F.encode(c, "UTF-8")), run)


def hashed_vector(tokens: Column, dims: int = 384) -> Column:
    """A model-free embedding: each word adds (hash mod 3) - 1 to the place its hash names; scaled to length 1.

    The places are few for a text, so they are looked up in a map of sums.
    """
    h = F.transform(tokens, lambda w: fnv1a(F.lower(w)))
    parts = F.transform(h, lambda x: F.struct((x % dims).cast("int").alias("i"), ((x % 3) - 1).cast("double").alias("v")))
    flat = let(parts, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(ps, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["v"])))
    return let(flat, normalise)
