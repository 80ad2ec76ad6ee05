"""Vertex names cut into words, and n-grams of names hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import FLOAT, NAN, float_text, let, to_float


def local_name(name: Column) -> Column:
    """Of a web name the last piece after ``#`` or white space, else the name."""
    piece = F.regexp_extract(name, r"([^#\s]+)[#\s]*$", 1)
    return F.when(name.contains("http") & (piece != ""), piece).otherwise(name)


def predicate_words(name: Column) -> Column:
    """Camel case taken apart."""
    return F.regexp_extract_all(local_name(name), F.lit("([A-Z][a-z]*|[^A-Z]+)"), 1)


def node_words(name: Column) -> Column:
    """A number as one word; else runs of letters and digits, and letters followed by digits as two."""
    pair = r"^([A-Za-z]+)([0-9]+)"

    def split(words: Column) -> Column:
        only = F.get(words, 0)
        two = F.array(F.regexp_extract(only, pair, 1), F.regexp_extract(only, pair, 2))
        return F.when((F.size(words) == 1) & only.rlike(pair), two).otherwise(words)

    def cut(own: Column) -> Column:
        words = let(F.regexp_extract_all(own, F.lit("([A-Za-z0-9]+)"), 1), split)
        return F.when(own.rlike(FLOAT) | own.rlike(NAN), F.array(float_text(to_float(own)))).otherwise(words)

    return let(local_name(name), cut)


def node_text(name: Column, gap: str) -> Column:
    """The lower-case :func:`node_words`, joined by ``gap`` (one that is neither letter nor digit), without taking names apart."""
    own = local_name(name)
    words = F.btrim(F.regexp_replace(own, "[^A-Za-z0-9]+", gap), F.lit(gap))
    pair = r"^([A-Za-z]+)([0-9]+)[A-Za-z0-9]*$"
    split = F.when(words.rlike(pair), F.regexp_replace(words, pair, f"$1{gap}$2")).otherwise(words)
    # Most names are two runs around one sign, and no numbers, as these don't begin with letters; translating is cheaper than patterns.
    signs = ":_./ -"
    return F.lower(F.when(own.rlike("^[A-Za-z][A-Za-z0-9]*[:_./ -][A-Za-z0-9]+$"), F.translate(own, signs, gap * len(signs))).when(own.rlike(FLOAT) | own.rlike(NAN), float_text(to_float(own))).otherwise(split))


def predicate_text(name: Column, gap: str) -> Column:
    """The lower-case :func:`predicate_words`, joined by ``gap``."""
    return F.lower(F.array_join(predicate_words(name), gap))


def ngrams(name: Column) -> Column:
    """The pieces of a web name around ``#`` and white space; else the name itself."""
    pieces = F.filter(F.split(name, r"[#\s]+"), lambda x: x != "")
    return F.when(name.contains("http"), pieces).otherwise(F.array(name))


#: FNV's start value and factor (fixed values).
FNV_START, FNV_FACTOR = 2166136261, 16777619


def fnv_bucket(text: Column, buckets: int) -> Column:
    """The FNV-1a hash of the UTF-8 bytes, on unbounded whole numbers, modulo ``buckets``.

    The exclusive-or touches the low eight bits only, so the hash modulo 256
    and modulo ``buckets`` are enough to go on from.
    """
    digits = F.hex(F.encode(text, "utf-8"))
    byte = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(FNV_START % 256).cast("bigint").alias("low"), F.lit(FNV_START % buckets).cast("bigint").alias("rest"))

    def step(state: Column, b: Column) -> Column:
        mixed = state["low"].bitwiseXOR(b)
        change = mixed - state["low"]
        return F.struct(F.pmod(mixed * FNV_FACTOR, F.lit(256)).cast("bigint").alias("low"), F.pmod(F.pmod(state["rest"] + change, F.lit(buckets)) * FNV_FACTOR, F.lit(buckets)).cast("bigint").alias("rest"))

    hashed = F.aggregate(byte, start, step, lambda s: s["rest"])
    return F.when(F.length(digits) == 0, F.lit(FNV_START % buckets).cast("bigint")).otherwise(hashed)
