"""Column helpers shared by the operators that stay in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that is not a word character once A-Z counts as a letter.
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    A column used inside a lambda may be inlined there by the optimizer and then be worked
    out for every element; a lambda variable can not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks, as they are."""
    return F.array_remove(F.split(whole(text), BLANKS, -1), "")


def alphanumeric_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all non-ASCII characters, in their own case."""
    return F.array_remove(F.split(whole(text), NOT_ALPHANUMERIC, -1), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def folded_hash(word: Column) -> Column:
    """Equal for words that are equal once A-Z are lowered (and for a few more)."""
    return F.xxhash64(F.lower(word))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` neighbours; bind ``hashes`` with ``let`` first."""
    if k == 1:
        return hashes
    last = F.size(hashes) - k
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]),
    )
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def covered(intervals: Column) -> Column:
    """Places covered by an array of structs (start, end), ends exclusive."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["to"], x["start"])
        more = F.greatest(x["end"] - begin, F.lit(0)).cast("long")
        return F.struct(
            F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + more).alias("n")
        )

    return F.aggregate(F.sort_array(intervals), start, step, lambda acc: acc["n"])
