"""A Bloom index of domains as a table of 64-bit words; probing is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SEEDS, WORD = 2_097_152, 5, 32


def fnv(text: Column, seed: int) -> Column:
    """32-bit FNV-1a over ASCII text, started at a seed."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF)
    chars = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substr(text, i, F.lit(1)))
    return F.aggregate(chars, F.lit((2166136261 ^ seed) & 0xFFFFFFFF).cast("long"), step)


def positions(text: Column) -> Column:
    return F.array(*[F.pmod(fnv(text, s), F.lit(BITS).cast("long")) for s in range(SEEDS)])


def build(domains: DataFrame) -> DataFrame:
    """word, bits: the words that are not zero."""
    at = domains.select(F.explode(positions(F.col("domain"))).alias("p"))
    bit = F.expr(f"shiftleft(1L, cast(p % {WORD} as int))")
    return at.select(F.floor(F.col("p") / WORD).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def probe(hosts: DataFrame, index: DataFrame) -> DataFrame:
    """Each distinct domain and whether it may be in the index; never false for one that is."""
    at = hosts.select("domain").distinct().select("domain", F.explode(positions(F.col("domain"))).alias("p")).withColumn("word", F.floor(F.col("p") / WORD).cast("long"))
    bit = F.expr(f"shiftright(bits, cast(p % {WORD} as int)) & 1")
    return at.join(index, "word", "left").groupBy("domain").agg(F.bool_and(F.coalesce(bit == 1, F.lit(False))).alias("maybe"))
