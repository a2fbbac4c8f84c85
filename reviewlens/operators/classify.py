"""A trained text classifier as a yardstick for the scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.functions.skew import join_counted_lookup
from reviewlens.functions.text import Tokenizer, tokens_full
from reviewlens.operators.comments import dense_ids
from reviewlens.session import new_folder, stage


def rated_text(lines: DataFrame) -> DataFrame:
    """Distinct lines of two tab-separated fields, a rating and a text."""
    fields = F.split("value", "\t")
    return (
        lines.filter(F.size(fields) == 2)
        .select(fields[0].try_cast("int").alias("rating"), fields[1].alias("text"))
        .filter(F.col("rating").isNotNull())
        .dropDuplicates(["rating", "text"])
    )


def balanced(rated: DataFrame) -> DataFrame:
    """All negative texts and as many positive ones, with a 0/1 label.

    Which positives are taken is fixed by the hash of the text.
    """
    rating = F.col("rating")
    rated = stage(rated, "rated")
    negative = rated.filter(rating < fixed.NEGATIVE_BELOW)
    wanted = negative.count()
    positive = dense_ids(
        rated.filter(rating == fixed.POSITIVE_RATING).withColumn("_hash", F.md5("text")),
        ["_hash", "text"],
        "_n",
    )
    both = negative.unionByName(
        positive.filter(F.col("_n") < wanted).select(*rated.columns)
    )
    return both.withColumn("label", F.when(rating > 4, 1).otherwise(0))


def tokenized(texts: DataFrame, tokenize: Tokenizer = tokens_full) -> DataFrame:
    return texts.withColumn("tokens", tokenize(F.col("text")))


def word_count(tokens: DataFrame) -> DataFrame:
    """Every word with its count, most frequent first (M3)."""
    return (
        tokens.select(F.explode("tokens").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("word"))
    )


def stop_words(tokens: DataFrame, n: int = fixed.STOP_WORDS) -> DataFrame:
    """The ``n`` most frequent words (M4)."""
    return word_count(tokens).limit(n)


def without_words(tokens: Column, words: Sequence[str]) -> Column:
    """The tokens left in order, repetitions kept (M5)."""
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def without_stop_words(tokens: DataFrame) -> DataFrame:
    words = [r["word"] for r in stop_words(tokens).collect()]
    return tokens.withColumn("tokens", without_words(F.col("tokens"), words))


def term_weights(tokens: DataFrame, key: str) -> DataFrame:
    """Term frequency and TF-IDF of every word of every text (M6, M7 without hashing).

    A frequent word is in most texts, so the word counts come in by the skew-proof join.
    """
    texts = tokens.count()
    tf = stage(
        tokens.select(key, F.explode("tokens").alias("word"))
        .groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("tf")),
        "tf",
    )
    # read three times, so it is written as well
    df = stage(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "df")
    weight = F.col("tf") * F.log((F.lit(texts) + 1.0) / (F.col("df") + 1.0))
    counted = df.withColumn("rows", F.col("df"))
    return join_counted_lookup(tf, counted, ["word"], "df", "rows").select(key, "word", "tf", weight.alias("tfidf"))


def split_60_40(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test part, decided by the hash of the text (M9)."""
    training = F.pmod(F.xxhash64("text"), F.lit(100)) < 60
    return data.filter(training), data.filter(~training)


def in_training(text: Column) -> Column:
    """True for 60 of 100 texts, by the first digits of their hash (M9)."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % 100 < 60


@dataclass(frozen=True)
class Bayes:
    """Naive Bayes over counted words: a table of log weights for both classes, and the log odds of
    the positive class. No word is hashed and none left out."""

    weights: DataFrame
    prior: float


def fit_bayes(training: DataFrame) -> Bayes:
    """From ``training`` (tokens, label 0 or 1), with every count raised by one."""
    positive = F.col("label") == 1
    counts = stage(
        training.select(F.explode("tokens").alias("word"), "label")
        .groupBy("word")
        .agg(F.count_if(~positive).alias("n_negative"), F.count_if(positive).alias("n_positive")),
        "word-counts",
    )
    total = counts.agg(
        F.sum("n_negative").alias("negative"), F.sum("n_positive").alias("positive"), F.count(F.lit(1)).alias("words")
    ).first()
    texts = training.agg(F.count_if(~positive).alias("negative"), F.count_if(positive).alias("positive")).first()
    weights = [
        F.log((F.col(f"n_{side}") + 1) / F.lit(float((total[side] or 0) + total["words"]))).alias(side)
        for side in ("negative", "positive")
    ]
    rows = (F.col("n_negative") + F.col("n_positive")).alias("rows")
    prior = math.log((texts["positive"] or 1) / (texts["negative"] or 1))
    return Bayes(stage(counts.select("word", *weights, rows), "word-weights"), prior)


def bayes_predictions(model: Bayes, tokens: DataFrame) -> DataFrame:
    """``tokens`` (text, tokens, ...) with ``prediction`` (M12). Unknown words don't count.

    Texts are taken apart under the hash of the text, and a frequent word meets its weight by a
    broadcast, so no key of the join holds many rows.
    """
    keyed = stage(tokens.withColumn("key", F.sha2("text", 256)), "keyed")
    words = stage(
        keyed.select("key", F.explode("tokens").alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf")),
        "words",
    )
    value = F.struct("negative", "positive").alias("weight")
    lookup = model.weights.select("word", value, "rows")
    found = join_counted_lookup(words, lookup, ["word"], "weight", "rows", F.col("rows") > 0)
    odds = found.groupBy("key").agg(
        F.sum(F.col("tf") * (F.col("weight.positive") - F.col("weight.negative"))).alias("odds")
    )
    total = F.coalesce("odds", F.lit(0.0)) + model.prior
    return keyed.join(odds, "key", "left").withColumn("prediction", (total > 0).cast("int")).drop("key", "odds")


def fit(training: DataFrame, kind: str = "svm") -> PipelineModel:
    """Hashed TF-IDF and a linear SVM or naive Bayes model.

    The model is kept in the shared folder and read back without its training history, which
    holds the session and could not be sent to the executors.
    """
    classifier = {
        "svm": lambda: LinearSVC(maxIter=100),
        "naive_bayes": lambda: NaiveBayes(smoothing=1.0),
    }[kind]()
    pipeline = Pipeline(
        stages=[
            HashingTF(inputCol="tokens", outputCol="tf"),
            IDF(inputCol="tf", outputCol="features"),
            classifier,
        ]
    )
    path = new_folder(training.sparkSession, "model")
    pipeline.fit(training).save(path)
    return PipelineModel.load(path)


def score(model: PipelineModel, tokens: DataFrame) -> DataFrame:
    """Predictions for new texts."""
    return model.transform(tokens).drop("tf", "features", "rawPrediction", "probability")


def accuracy(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Share of right predictions."""
    right = F.col("prediction") == F.col("label")
    return score(model, test).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(right.cast("int")).alias("accuracy")
    )


def train_and_test(rated: DataFrame, kind: str = "svm") -> DataFrame:
    """The whole job: balance, tokenise, drop stop words, train on 60 %, test on the rest."""
    tokens = stage(tokenized(balanced(rated)), "tokens")
    data = stage(
        without_stop_words(tokens).select("text", "tokens", F.col("label").cast("double")), "data"
    )
    training, test = split_60_40(data)
    return accuracy(fit(training, kind), test)
