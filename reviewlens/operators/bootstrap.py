"""Growing feature and sentiment words from a few seed features.

Whether a pair is accepted depends only on its two words, and on which word became known
first. So the rounds run on the distinct word pairs of each product, never on the pairs
themselves, and the label of every word pair is joined back once at the end.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.functions.skew import join_counted_lookup
from reviewlens.functions.text import any_of
from reviewlens.operators.pairs import feature_length_ok, sentiment_length_ok
from reviewlens.session import drop_table, new_folder, stage

SEEDS = any_of(fixed.SEED_FEATURES)
PENDING, REJECTED, ACCEPTED = 0, 1, -1
EDGE = ["pId", "f", "fpos", "s", "spos"]
_REACHED = "pId bigint, word string, t int"


def tag(word: Column) -> Column:
    """The tag of a word, empty when it has none, so that it equals itself in joins."""
    return F.coalesce(word["pos"], F.lit(""))


def word_edges(pairs: DataFrame, seeds: str = SEEDS) -> DataFrame:
    """Distinct word pairs of each product with the number of pairs ``n`` behind them.

    Only pairs with a valid feature length take part. A sentiment of invalid length is
    null: such pairs still count for their seed feature and are rejected otherwise.
    """
    feature, sentiment = F.col("feature"), F.col("sentiment")
    valid = sentiment_length_ok(sentiment)
    return (
        pairs.filter(feature_length_ok(feature))
        .select(
            "pId",
            feature["cont"].alias("f"),
            tag(feature).alias("fpos"),
            F.when(valid, sentiment["cont"]).alias("s"),
            F.when(valid, tag(sentiment)).alias("spos"),
            feature["cont"].rlike(seeds).alias("seed"),
        )
        .filter(F.col("seed") | F.col("s").isNotNull())
        .groupBy(*EDGE, "seed")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged_edges(*edges: DataFrame) -> DataFrame:
    """Word pairs of several deliveries as one table, their counts added up."""
    every = reduce(DataFrame.unionByName, edges)
    return every.groupBy(*EDGE, "seed").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Step:
    """What one step of the discovery read and found."""

    t: int
    links: int
    used: int
    words: int
    seconds: float


class _Links:
    """Links from the words of one side to those of the other, stored by the side they start from.

    A link is used in the step after its start became known and never again. Once half of the
    stored links are used up they are dropped, so what a step reads falls with what is left.
    The table is bucketed by the start: a step shuffles its newest words and no link.
    """

    def __init__(self, links: DataFrame, start: str, end: str):
        self._spark = links.sparkSession
        self.start, self.end = start, end
        self._table = self._path = ""
        self._write(links.select("pId", start, end))

    def _write(self, links: DataFrame) -> None:
        counted, old = Observation(), (self._table, self._path)
        name = f"links_{uuid.uuid4().hex}"
        path = new_folder(self._spark, name)
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt out first, so that each task writes the one bucket that it holds
        dealt = links.repartition(buckets, "pId", self.start).observe(counted, F.count(F.lit(1)).alias("n"))
        (
            dealt.write.option("path", path)
            .bucketBy(buckets, "pId", self.start)
            .saveAsTable(name)
        )
        self._table, self._path, self.stored, self.used = name, path, counted.get["n"], 0
        if old[0]:
            drop_table(self._spark, *old)

    def table(self) -> DataFrame:
        return self._spark.read.table(self._table)

    def from_words(self, words: DataFrame) -> DataFrame:
        """The words (pId, word) that links from ``words`` (pId, word) lead to, with their number."""
        found = self.table().join(words.withColumnRenamed("word", self.start), ["pId", self.start])
        return found.groupBy("pId", F.col(self.end).alias("word")).agg(F.count(F.lit(1)).alias("links"))

    def drop_used(self, used: int, known: DataFrame) -> None:
        self.used += used
        if 2 * self.used >= self.stored > 0:
            starts = known.select("pId", F.col("word").alias(self.start))
            self._write(self.table().join(starts, ["pId", self.start], "left_anti"))

    def drop(self) -> None:
        drop_table(self._spark, self._table, self._path)


class _Reached:
    """The words of one side found so far, one folder per time step."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._path = new_folder(spark, name)
        self._written = False

    def add(self, words: DataFrame, t: int) -> tuple[int, int]:
        """Keep those of ``words`` (pId, word, links) that are new at step ``t``; how many they are,
        and the links that led to all of them.

        The numbers are observed above all joins, as the planner drops what it sees to be empty.
        """
        counted = Observation()
        had = self.known().select("pId", "word", F.lit(True).alias("had"))
        judged = words.join(had, ["pId", "word"], "left").observe(
            counted,
            F.count_if(F.col("had").isNull()).alias("words"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
        )
        judged.filter("had is null").select("pId", "word").write.parquet(f"{self._path}/t={t}")
        self._written = True
        return counted.get["words"], counted.get["links"]

    def known(self) -> DataFrame:
        return self.table() if self._written else self._spark.createDataFrame([], _REACHED)

    def table(self) -> DataFrame:
        return self._spark.read.schema(_REACHED).parquet(self._path)

    def at(self, t: int) -> DataFrame:
        return self.table().filter(F.col("t") == t).select("pId", "word")


def _directed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeded sentiments (pId, word), links to features and links to sentiments."""
    adjective = F.col("spos") == fixed.SENTIMENT_POS
    seeded = edges.filter(F.col("seed") & adjective).select("pId", F.col("s").alias("word")).distinct()
    links = edges.filter(~F.col("seed"))
    to_feature = links.filter(F.col("fpos").isin(fixed.FEATURE_POS)).select("pId", "s", "f").distinct()
    return seeded, to_feature, links.filter(adjective).select("pId", "f", "s").distinct()


def discovery_times(
    edges: DataFrame, log: Callable[[Step], None] = lambda step: None
) -> tuple[DataFrame, DataFrame]:
    """(features, sentiments) with the step at which each word of a product becomes known.

    Step 0 takes the sentiments of seed pairs, odd steps go from new sentiments to features,
    even steps back. Each step joins only the newest words with the links that are left, and
    its result is a table, so a lost executor costs no more than the step at hand. The number
    of words found is observed as they are written. ``log`` is told of every step.
    """
    spark = edges.sparkSession
    seeded, to_feature, to_sentiment = _directed(edges)
    features, sentiments = _Reached(spark, "features"), _Reached(spark, "sentiments")
    sides = [(sentiments, _Links(to_feature, "s", "f")), (features, _Links(to_sentiment, "f", "s"))]
    begin, t = time.monotonic(), 0
    words, _ = sentiments.add(seeded.withColumn("links", F.lit(0)), 0)
    log(Step(0, 0, 0, words, time.monotonic() - begin))
    while words:
        begin = time.monotonic()
        (source, links), (target, _) = sides if t % 2 == 0 else sides[::-1]
        t += 1
        read = links.stored
        words, used = target.add(links.from_words(source.at(t - 1)), t)
        links.drop_used(used, source.known())
        log(Step(t, read, used, words, time.monotonic() - begin))
    for _, links in sides:
        links.drop()
    return features.known(), sentiments.known()


def extended_times(
    times: tuple[DataFrame, DataFrame], edges: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The discovery times of ``edges`` once ``new_edges`` have come to them.

    ``times`` are those of the edges before and ``edges`` are all of them by now. New edges can
    only let a word be found earlier, so the first round looks at what they lead to, and each
    further round only at words whose time fell in the one before.
    """
    spark = edges.sparkSession
    seeded, to_feature, to_sentiment = _directed(edges)
    all_links = {"s": _Links(to_feature, "s", "f"), "f": _Links(to_sentiment, "f", "s")}
    new_seeded, *new_links = _directed(new_edges)
    start = {"s": "f", "f": "s"}
    current = {"f": times[0], "s": times[1]}

    def earlier(side: str, offered: DataFrame) -> DataFrame:
        """The offered times (pId, word, t) that are earlier than those at hand, written."""
        least = offered.groupBy("pId", "word").agg(F.min("t").cast("int").alias("t"))
        had = current[side].select("pId", "word", F.col("t").alias("had"))
        better = least.join(had, ["pId", "word"], "left").filter("had is null or t < had")
        return stage(better.drop("had"), "earlier")

    def reached(links: DataFrame, of: str, words: DataFrame) -> DataFrame:
        """Times that ``words`` of the side ``of`` offer to the other side."""
        known = words.withColumnRenamed("word", of)
        return links.join(known, ["pId", of]).select("pId", F.col(start[of]).alias("word"), (F.col("t") + 1).alias("t"))

    def take(side: str, better: DataFrame) -> None:
        both = current[side].unionByName(better)
        current[side] = stage(both.groupBy("pId", "word").agg(F.min("t").alias("t")), "times")

    seeds = earlier("s", new_seeded.withColumn("t", F.lit(0)))
    take("s", seeds)
    fallen = {"s": seeds, "f": spark.createDataFrame([], _REACHED)}
    offered = {
        "f": reached(new_links[0], "s", current["s"]),
        "s": reached(new_links[1], "f", current["f"]),
    }
    while True:
        better = {}
        for side, other in (("f", "s"), ("s", "f")):
            through = reached(all_links[other].table(), other, fallen[other])
            better[side] = earlier(side, through.unionByName(offered[side]) if side in offered else through)
        for side, found in better.items():
            take(side, found)
        fallen, offered = better, {}
        if all(found.isEmpty() for found in better.values()):
            break
    for links in all_links.values():
        links.drop()
    return current["f"], current["s"]


def label_edges(edges: DataFrame, times: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every word pair with its label and ``by``: the side that was known first."""
    features, sentiments = times or discovery_times(edges)
    t_s = F.coalesce(F.col("t_s"), F.lit(1 << 30))
    t_f = F.coalesce(F.col("t_f"), F.lit(1 << 30))
    by = (
        F.when(F.col("seed") | (F.col("t_s").isNull() & F.col("t_f").isNull()), None)
        .when(t_s < t_f, "sentiment")
        .otherwise("feature")
    )
    adjective = F.col("spos") == fixed.SENTIMENT_POS
    accepted = (
        F.when(F.col("seed"), F.coalesce(adjective, F.lit(False)))
        .when(F.col("by") == "sentiment", F.col("fpos").isin(fixed.FEATURE_POS))
        .when(F.col("by") == "feature", adjective)
    )
    label = (
        F.when(accepted, ACCEPTED).when(accepted.isNull(), PENDING).otherwise(REJECTED)
    )
    return (
        edges.join(
            sentiments.select("pId", F.col("word").alias("s"), F.col("t").alias("t_s")),
            ["pId", "s"],
            "left",
        )
        .join(
            features.select("pId", F.col("word").alias("f"), F.col("t").alias("t_f")),
            ["pId", "f"],
            "left",
        )
        .withColumn("by", by)
        .withColumn("label", label)
        .select(*EDGE, "seed", "n", "by", "label")
    )


def bootstrap(pairs: DataFrame, seeds: str = SEEDS) -> DataFrame:
    """Labelled word pairs of every product, as a stage table."""
    return stage(label_edges(stage(word_edges(pairs, seeds), "edges")), "labelled")


def _keyed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {
            "f": F.col("feature.cont"),
            "fpos": tag(F.col("feature")),
            "s": F.col("sentiment.cont"),
            "spos": tag(F.col("sentiment")),
        }
    )


def _valid() -> Column:
    return F.coalesce(
        feature_length_ok(F.col("feature")) & sentiment_length_ok(F.col("sentiment")), F.lit(False)
    )


def label_pairs(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every pair with its label (C7, C12, C13). ``pairs`` is read three times, so pass a table."""
    lookup = labelled.filter(F.col("s").isNotNull()).select(*EDGE, "n", "label")
    matched = join_counted_lookup(_keyed(pairs.filter(_valid())), lookup, EDGE, "label", "n").drop(*EDGE[1:])
    short = pairs.filter(~_valid()).withColumn("label", F.lit(REJECTED))
    return matched.unionByName(short)


def accepted_opinions(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The accepted pairs; clauses and comments without one vanish.

    Only accepted word pairs are looked up: rejected ones of the frequent word pairs are left
    where they are read, and the shuffle brings together the others alone.
    """
    lookup = labelled.filter(F.col("s").isNotNull()).select(*EDGE, "n", "label")
    accepted = F.col("label") == ACCEPTED
    return join_counted_lookup(_keyed(pairs.filter(_valid())), lookup, EDGE, "label", "n", accepted).drop(
        *EDGE[1:], "label"
    )


def nest_opinions(opinions: DataFrame) -> DataFrame:
    """One row per comment with its clauses and their opinions in order (C14).

    Both groupings use the same partitioning by comment, so rows move once.
    """
    one = F.struct("pairNo", F.struct("feature", "sentiment", "relate").alias("o"))
    return (
        opinions.repartition("pId", "cId")
        .groupBy("pId", "cId", "sId")
        .agg(F.sort_array(F.collect_list(one)).getField("o").alias("sFeaSenPairs"))
        .groupBy("pId", "cId")
        .agg(F.sort_array(F.collect_list(F.struct("sId", "sFeaSenPairs"))).alias("cFeaSenPairs"))
    )


def feature_words(labelled: DataFrame, threshold: int = fixed.VOCABULARY_THRESHOLD) -> DataFrame:
    """Seed features with their counts, and learned features above the threshold."""
    n = F.col("n")
    learned = F.when(F.col("by") == "feature", n).when(
        (F.col("by") == "sentiment") & (F.col("label") == ACCEPTED), n
    )
    return (
        labelled.groupBy("pId", F.col("f").alias("name"), "seed")
        .agg(F.sum(F.when(F.col("seed"), n).otherwise(learned)).alias("freq"))
        .filter(F.col("freq").isNotNull() & (F.col("seed") | (F.col("freq") > threshold)))
        .select("pId", "name", "freq")
    )


def sentiment_words(labelled: DataFrame, threshold: int = fixed.VOCABULARY_THRESHOLD) -> DataFrame:
    """Learned sentiments above the threshold."""
    counts = (F.col("by") == "sentiment") | (F.col("label") == ACCEPTED)
    return (
        labelled.filter(counts)
        .groupBy("pId", F.col("s").alias("name"))
        .agg(F.sum("n").alias("freq"))
        .filter(F.col("freq") > threshold)
    )


def seed_pass(pairs: DataFrame, seeds: str = SEEDS) -> DataFrame:
    """Labels of the first pass alone: pairs of seed features and of invalid length."""
    feature, sentiment = F.col("feature"), F.col("sentiment")
    good = sentiment_length_ok(sentiment) & (sentiment["pos"] == fixed.SENTIMENT_POS)
    label = (
        F.when(~feature_length_ok(feature), REJECTED)
        .when(~feature["cont"].rlike(seeds), PENDING)
        .when(good, ACCEPTED)
        .otherwise(REJECTED)
    )
    return pairs.withColumn("label", label)
