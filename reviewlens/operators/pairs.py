"""Word pairs of a parsed clause.

A clause is one row holding its words as an array, so pairs come out of a projection and no
word is ever shuffled. Only ids, parents and relations are looked at to find the places of the
two words; the words themselves are fetched after the pairs have become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.functions.clause_places import BASE, CROSS, DEPENDENT, clause_places, comment_places
from reviewlens.functions.nested import rows_of
from reviewlens.functions.text import length_between
from reviewlens.operators.negation import negating_adverb, negating_adverbs, opens_adversative

PAIR_KEY = ["pId", "cId", "sId", "pairNo"]
#: What the places of the pairs are worked out from.
_LINKS = ("id", "parent", "relate")


def pair_places(words: Column) -> Column:
    """The pairs of one clause in order, as places.

    Attribute and subject come before their head, the other dependents after it. A pair that
    lacks a side is left out.
    """
    return clause_places(*[words.getField(name) for name in _LINKS])


def _kind(place: Column) -> Column:
    return (
        F.when(place["kind"] == BASE, "base")
        .when(place["kind"] == CROSS, "cross")
        .when(place["kind"] == DEPENDENT, "dependent")
        .otherwise("head")
    )


def comment_pairs(comments_dp: DataFrame) -> DataFrame:
    """Nested form: every clause of every comment with its pairs, also when it has none."""

    def of_clauses(name: str) -> Column:
        return F.transform("cDpResult", lambda s: s["sDpResult"].getField(name))

    def clause(s: Column, i: Column) -> Column:
        def pair(place: Column) -> Column:
            def word(name: str) -> Column:
                return F.get(s["sDpResult"], place[name])

            return F.struct(
                word("first").alias("first"),
                word("second").alias("second"),
                word("word")["relate"].alias("wRelate"),
            )

        pairs = F.transform(F.get("places", i), pair)
        return F.struct(s["sId"].alias("sId"), pairs.alias("sDpPairs"))

    placed = comments_dp.withColumn("places", comment_places(*[of_clauses(name) for name in _LINKS]))
    return placed.select("pId", "cId", F.transform("cDpResult", clause).alias("cDpPairs"))


def _pair_rows(clauses: DataFrame, *carried: Column) -> DataFrame:
    """One row per pair: its key, its place, the words of the clause and columns of the clause."""
    places = pair_places(F.col("words")).alias("places")
    return (
        clauses.select(*PAIR_KEY[:3], "words", places, *carried)
        .select("*", F.posexplode_outer("places").alias("pairNo", "place"))
        .drop("places")
        .filter(F.col("place").isNotNull())
    )


def _relate(words: Column, place: Column) -> Column:
    return F.get(words, place["word"])["relate"].alias("relate")


def dependency_pairs(clauses: DataFrame) -> DataFrame:
    """Flat form: one row per pair, numbered within its clause."""
    words, place = F.col("words"), F.col("place")
    return _pair_rows(clauses).select(
        *PAIR_KEY,
        F.get(words, place["first"]).alias("first"),
        F.get(words, place["second"]).alias("second"),
        _relate(words, place),
        _kind(place).alias("kind"),
    )


def flat_pairs(comment_pairs_df: DataFrame) -> DataFrame:
    """The nested form as rows."""
    return (
        rows_of(comment_pairs_df, "cDpPairs", "s", "pId", "cId")
        .select("pId", "cId", "s.sId", F.posexplode("s.sDpPairs").alias("pairNo", "p"))
        .select(*PAIR_KEY, "p.first", "p.second", F.col("p.wRelate").alias("relate"))
    )


def opinion_sides(first: Column, second: Column, relate: Column) -> tuple[Column, Column]:
    """(feature, sentiment): the head of an attribute is the feature, else the first word."""
    attribute = relate == "ATT"
    return (
        F.when(attribute, second).otherwise(first),
        F.when(attribute, first).otherwise(second),
    )


def with_sides(pairs: DataFrame) -> DataFrame:
    feature, sentiment = opinion_sides(F.col("first"), F.col("second"), F.col("relate"))
    return pairs.withColumns({"feature": feature, "sentiment": sentiment})


def feature_length_ok(feature: Column) -> Column:
    return length_between(feature["cont"], fixed.FEATURE_LENGTH)


def sentiment_length_ok(sentiment: Column) -> Column:
    return length_between(sentiment["cont"], fixed.SENTIMENT_LENGTH)


def opinion_candidates(
    clauses: DataFrame,
    seeds: str,
    negation: str,
    adversative: str,
    id_order: str = "numeric",
) -> DataFrame:
    """Pairs that can become opinions, with everything later stages need of the clause.

    Left out are pairs that are rejected for their word lengths whatever else is found; a
    seed feature is kept with any sentiment, because the pair counts for the feature. The
    negating adverb and the adversative opening are read here, where the words are at hand,
    so the mined pairs never have to be joined with the parses again.
    """
    words, place = F.col("words"), F.col("place")
    feature_place, sentiment_place = opinion_sides(
        place["first"], place["second"], _relate(words, place)
    )
    feature, sentiment = F.get(words, feature_place), F.get(words, sentiment_place)
    can_matter = feature_length_ok(feature) & (
        sentiment_length_ok(sentiment) | feature["cont"].rlike(seeds)
    )
    pairs = _pair_rows(
        clauses,
        opens_adversative(words, adversative).alias("adversative"),
        negating_adverbs(words, negation).alias("adverbs"),
    )
    return (
        pairs.filter(can_matter)
        .select(
            *PAIR_KEY,
            "adversative",
            "adverbs",
            feature.alias("feature"),
            sentiment.alias("sentiment"),
            _relate(words, place),
        )
        .withColumn(
            "neg_adv",
            negating_adverb(F.col("feature"), F.col("sentiment"), F.col("adverbs"), id_order),
        )
        .drop("adverbs")
    )
