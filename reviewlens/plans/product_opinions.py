"""From parsed reviews to product summaries, for all products in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import bootstrap, scoring, summary, tags
from reviewlens.operators import negation as clause_words
from reviewlens.operators.pairs import opinion_candidates
from reviewlens.session import stage


@dataclass(frozen=True)
class Rules:
    """The patterns that depend on the language of the reviews."""

    seeds: str = bootstrap.SEEDS
    negation: str = clause_words.NEGATION
    adversative: str = clause_words.ADVERSATIVE
    id_order: str = "numeric"


@dataclass(frozen=True)
class Mined:
    """Candidate pairs and the labelled vocabulary, both stage tables."""

    candidates: DataFrame
    labelled: DataFrame

    def opinions(self) -> DataFrame:
        return bootstrap.accepted_opinions(self.candidates, self.labelled)

    def tuples(self) -> DataFrame:
        return clause_words.after_last_adversative(self.opinions())

    def feature_words(self) -> DataFrame:
        return bootstrap.feature_words(self.labelled)

    def sentiment_words(self) -> DataFrame:
        return bootstrap.sentiment_words(self.labelled)


def mine(clauses: DataFrame, rules: Rules = Rules()) -> Mined:
    """Read the parses once, keep the pairs that can matter, and grow the vocabulary."""
    candidates = stage(
        opinion_candidates(
            clauses, rules.seeds, rules.negation, rules.adversative, rules.id_order
        ),
        "candidates",
    )
    return Mined(candidates, bootstrap.bootstrap(candidates, rules.seeds))


@dataclass(frozen=True)
class Report:
    """Scored opinions as a stage table, and what is reported from them."""

    degrees: DataFrame
    features: DataFrame

    def comment_degrees(self) -> DataFrame:
        return scoring.comment_degrees(self.degrees)

    def feature_tags(self) -> DataFrame:
        return tags.feature_tags(scoring.polar(self.degrees), self.features)

    def tag_comments(self) -> DataFrame:
        return tags.tag_comments(scoring.polar(self.degrees), self.features)

    def hot_tags(self) -> DataFrame:
        return tags.hot_tags(self.feature_tags())

    def product_totals(self) -> DataFrame:
        return summary.product_totals(self.comment_degrees())

    def product_summary(self) -> DataFrame:
        return summary.product_summary(self.product_totals(), self.hot_tags())


def score(mined: Mined, lexicon: DataFrame, synonyms: DataFrame) -> DataFrame:
    return scoring.score_tuples(mined.tuples(), scoring.word_polarity(lexicon, synonyms))


def report(mined: Mined, lexicon: DataFrame, synonyms: DataFrame) -> Report:
    kept = score(mined, lexicon, synonyms).select(
        "pId",
        "cId",
        F.struct("feature.cont").alias("feature"),
        F.struct("sentiment.cont").alias("sentiment"),
        F.struct("neg_adv.cont").alias("neg_adv"),
        "deg_value",
    )
    return Report(stage(kept, "degrees"), stage(mined.feature_words(), "features"))
