"""Negating adverbs and adversative clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.functions.nested import let
from reviewlens.functions.text import any_of, contains_any

NEGATION = any_of(fixed.NEGATION_WORDS)
ADVERSATIVE = any_of(fixed.ADVERSATIVE_WORDS)


def opens_adversative(words: Column, pattern: str = ADVERSATIVE) -> Column:
    """The clause starts with a conjunction or adverb that turns against what came before."""
    first = F.get(words, F.lit(0))
    return F.coalesce(
        first["pos"].isin(fixed.ADVERSATIVE_POS) & contains_any(first["cont"], pattern),
        F.lit(False),
    )


def negating_adverbs(words: Column, pattern: str = NEGATION) -> Column:
    """The adverbs of a clause that negate, in order."""
    return F.filter(
        words, lambda w: (w["relate"] == fixed.ADVERBIAL) & contains_any(w["cont"], pattern)
    )


def negating_adverb(
    feature: Column, sentiment: Column, adverbs: Column, id_order: str = "numeric"
) -> Column:
    """The last of the sentiment's ``adverbs`` between feature and sentiment, null when their
    number is even (D4, D5). With ``id_order="lexical"`` word ids are compared as strings.
    """
    kind = {"numeric": "int", "lexical": "string"}[id_order]
    after, before = feature["id"].cast(kind), sentiment["id"].cast(kind)
    between = F.filter(
        adverbs,
        lambda w: (w["parent"] == sentiment["id"])
        & (w["id"].cast(kind) > after)
        & (w["id"].cast(kind) < before),
    )
    return let(
        between,
        lambda hits: F.when(F.size(hits) % 2 == 1, F.try_element_at(hits, F.lit(-1))),
    )


def with_clause_context(
    opinions: DataFrame,
    clauses: DataFrame,
    negation: str = NEGATION,
    adversative: str = ADVERSATIVE,
    id_order: str = "numeric",
) -> DataFrame:
    """Opinions read from a table, joined with the clauses they came from.

    One join on the clause key for all comments. An opinion without its clause is left out;
    ``opinions_without_clause`` has those, for the account of left-out rows.
    """
    neg_adv = negating_adverb(
        F.col("feature"), F.col("sentiment"), F.col("adverbs"), id_order
    )
    context = clauses.select(
        "pId",
        "cId",
        "sId",
        negating_adverbs(F.col("words"), negation).alias("adverbs"),
        opens_adversative(F.col("words"), adversative).alias("adversative"),
    )
    return (
        opinions.join(context, ["pId", "cId", "sId"])
        .withColumn("neg_adv", neg_adv)
        .drop("adverbs")
    )


def opinions_without_clause(opinions: DataFrame, clauses: DataFrame) -> DataFrame:
    return opinions.join(clauses.select("pId", "cId", "sId"), ["pId", "cId", "sId"], "left_anti")


def after_last_adversative(tuples: DataFrame) -> DataFrame:
    """Drop the opinions of clauses before the comment's last adversative clause (D3)."""
    comment = Window.partitionBy("pId", "cId")
    last = F.max(F.when(F.col("adversative"), F.col("sId"))).over(comment)
    return (
        tuples.withColumn("_last", last)
        .filter(F.col("_last").isNull() | (F.col("sId") >= F.col("_last")))
        .drop("_last")
    )


def negated(tuples: DataFrame) -> DataFrame:
    """The opinions that carry a negation."""
    return tuples.filter(F.col("neg_adv").isNotNull())
