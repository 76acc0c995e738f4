"""Matching against a lexicon that no executor holds.

A Bloom filter of the terms' keys is built by an aggregate, a bit vector of bounded
size whatever the lexicon holds. Runs of words of the texts that it lets pass are
written once, with their counts, and meet the terms in a shuffle join, in which the
rows of hot runs are salted. Every match is confirmed on the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.operators.staging import Staging

# Bits per key of the filter, bits it has at most (32 MB), and bits set per key.
BITS_PER_KEY, MOST_BITS, LOOKUPS = 16, 1 << 28, 4
# A key of more than one in this many rows is hot, so there are fewer hot keys than that.
HOT_SHARE = 10_000
SALTS = 64


def filter_bits(keys: int) -> int:
    """A power of two, with room for so many keys up to a bound."""
    return min(MOST_BITS, 1 << max(10, (BITS_PER_KEY * keys - 1).bit_length()))


def _positions(key: Column, bits: int) -> list[Column]:
    """From the two halves of a key that is a hash; ``bits`` is a power of two."""
    return [
        (key + F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1)) * F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(LOOKUPS)
    ]


def key_filter(keys: DataFrame, bits: int) -> DataFrame:
    """(bits): one row, the filter of all ``keys(hash)`` as 64-bit words.

    Words are united by OR before and after the shuffle, so filters of parts merge.
    """
    place = F.explode(F.array(*_positions(F.col("hash"), bits)))
    words = (
        keys.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    )
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    both = F.struct("id", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    return every.agg(F.transform(F.array_sort(F.collect_list(both)), lambda w: w["set"]).alias("bits"))


def may_hold(vector: Column, key: Column, bits: int) -> Column:
    """Can the filter hold the key? Never wrongly no."""
    def set_at(place: Column) -> Column:
        word = F.get(vector, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return reduce(Column.__and__, map(set_at, _positions(key, bits)))


def found(grams: DataFrame, keyed: DataFrame, staging: Staging, salts: int = SALTS) -> DataFrame:
    """(guid, term, n, listings) of the ``grams(guid, gram, times, hash)`` that are terms.

    ``keyed(term, hash, listings)`` are the terms. The texts are read once, and a guid meets
    a term once, however often it holds it: one shuffle brings its rows together and to the term.
    """
    bits = filter_bits(keyed.agg(F.count_distinct("hash").alias("keys")).first()["keys"])
    vector = staging.written(key_filter(keyed.select("hash").distinct(), bits), "filter").scalar()
    passed = staging.written(grams.where(may_hold(vector, F.col("hash"), bits)), "passed")
    # Numbers of fewer than HOT_SHARE keys, and no terms, are broadcast.
    counts = staging.written(passed.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "counts")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(
        staging.written(counts.where(F.col("rows") * HOT_SHARE > total).select("hash", F.lit(True).alias("hot")), "hot")
    )
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("guid"), F.lit(salts))).otherwise(0).cast("int")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = (
        passed.join(hot, "hash", "left")
        .withColumn("salt", salt)
        .repartition("hash", "salt")
        .groupBy("hash", "salt", "guid", "gram")
        .agg(F.sum("times").alias("n"))
    )
    right = keyed.join(hot, "hash", "left").withColumn("salt", F.explode(every)).drop("hot")
    return (
        left.join(right.hint("shuffle_merge"), ["hash", "salt"])
        .where(F.startswith("gram", "term") & F.startswith("term", "gram"))
        .select("guid", "term", "n", "listings")
    )
