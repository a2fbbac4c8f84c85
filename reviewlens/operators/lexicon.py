"""Polarity word lists and the synonym table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.text import is_cjk, stripped
from reviewlens.sources.text_files import read_lines


def clean_words(lines: DataFrame, cjk_only: bool = True) -> DataFrame:
    """The words of a list, without blank lines and, if asked, only those all in CJK."""
    words = lines.select(stripped(F.col("value")).alias("word")).filter(F.col("word") != "")
    return words.filter(is_cjk(F.col("word"))) if cjk_only else words


def build_word_list(cjk_lists: Sequence[DataFrame], plain_lists: Sequence[DataFrame]) -> DataFrame:
    """Distinct words of several lists (E1, E2). One distinct over the union does for all."""
    cleaned = [clean_words(x) for x in cjk_lists] + [clean_words(x, False) for x in plain_lists]
    return reduce(DataFrame.unionByName, cleaned).distinct()


def lexicon(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Both word lists as ``schemas.LEXICON``."""
    return negative.select("word", F.lit(-1).alias("polarity")).unionByName(
        positive.select("word", F.lit(1).alias("polarity"))
    )


def read_lexicon(spark: SparkSession, negative_path: str, positive_path: str) -> DataFrame:
    lists = [clean_words(read_lines(spark, p), False) for p in (negative_path, positive_path)]
    return lexicon(*lists)


def synonym_table(lines: DataFrame) -> DataFrame:
    """Lines ``key word word ...`` whose key has an equals sign, as ``schemas.SYNONYMS``."""
    parts = F.split("value", " ")
    return (
        lines.filter(parts[0].contains("="))
        .select(parts[0].alias("grp"), F.posexplode(F.slice(parts, 2, F.size(parts))))
        .select("grp", "pos", F.col("col").alias("word"))
        .filter(F.col("word") != "")
    )
