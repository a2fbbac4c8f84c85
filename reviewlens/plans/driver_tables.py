"""Stage inputs from the driver's tables.

The tables hold no dependency parses, ratings or review pages, so these are derived by
formula. Whole texts are used: every clause and every word, without a limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.operators.lexicon import synonym_table
from reviewlens.operators.pairs import sentiment_length_ok
from reviewlens.plans.derived_words import HEAD_STEPS, POS, RELATIONS, derived_clauses, derived_xml
from reviewlens.plans.product_opinions import Rules

SEEDS = "^(the|ch|au|das)"
NEGATION = "un|no|de|th"
ADVERSATIVE = "die|the|la|es"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unspaced(text: Column) -> Column:
    """Latin letters written as CJK characters, without the blanks between words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    written = "".join(chr(0x4E00 + i) for i in range(26))
    return F.translate(F.replace(text, F.lit(" "), F.lit("")), letters + letters.upper(), written * 2)


def product_of(source: Column) -> Column:
    return F.substr(source, F.lit(4)).cast("long")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scanned table dealt out evenly, as a row group of any size is read by one task.

    The pairs of a text cost far more than moving it once. The session's number of shuffle
    partitions is given, as the texts' size says little about the work they make.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated comments: documents that have a label."""
    rating = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 5)
        .when(F.col("quality") == 1, 3)
        .otherwise(1)
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(documents, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select(
        product_of(F.col("source")).alias("pId"),
        F.col("doc_id").alias("cId"),
        F.col("text").alias("content"),
        rating.alias("score"),
    )


def _sentences(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return (
        spread(documents, "doc_id")
        .select(
            product_of(F.col("source")).alias("pId"),
            F.col("doc_id").alias("cId"),
            F.posexplode(F.split(text, "[.\n]+")).alias("sId", "content"),
        )
        .withColumn("content", F.trim("content"))
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short comments: the sentences of all documents."""
    return _sentences(spark, sf_dir, F.col("text"))


def _word(cont: Column, i: Column) -> Column:
    def pick(values: list, n: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), n)

    relate = pick(RELATIONS, i % 6)
    parent = F.coalesce(i + pick(HEAD_STEPS, i % 24), F.lit(-1))
    return F.struct(
        i.alias("id"),
        cont.alias("cont"),
        pick(POS, (F.char_length(cont) + i) % 4).alias("pos"),
        F.lit("O").alias("ne"),
        parent.alias("parent"),
        relate.alias("relate"),
    )


def _words(sentence: Column) -> Column:
    """Words of a sentence: the runs without blanks."""
    return F.split(F.trim(sentence), " +")


def _parsed(sentence: Column) -> Column:
    return F.transform(_words(sentence), _word)


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed clauses of all documents, one per row."""
    return (
        _sentences(spark, sf_dir, F.lower("text"))
        .filter(F.col("content") != "")
        .select("pId", "cId", "sId", _parsed(F.col("content")).alias("words"))
    )


def parsed_comments(numbered: DataFrame) -> DataFrame:
    """Short comments (pId, number, content) as parsed clauses, one of each."""
    parsed = _parsed(F.lower("content"))
    return numbered.filter(F.col("content") != "").select(
        "pId", F.col("number").alias("cId"), F.lit(0).alias("sId"), parsed.alias("words")
    )


def _derived(spark: SparkSession, sf_dir: str, name: str, derive: Callable[[Column], Column]) -> DataFrame:
    """(pId, cId) of all documents with what ``derive`` makes of their clauses (sId, content)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sentences_ = F.filter(
        F.transform(
            F.split(F.lower("text"), "[.\n]+"),
            lambda s, i: F.struct(i.alias("sId"), F.trim(s).alias("content")),
        ),
        lambda s: s["content"] != "",
    )
    return spread(documents, "doc_id").select(
        product_of(F.col("source")).alias("pId"), F.col("doc_id").alias("cId"), derive(sentences_).alias(name)
    )


def comments_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clauses, all those of a document in one row, derived for many documents at once."""
    return _derived(spark, sf_dir, "cDpResult", derived_clauses)


def comments_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parses of a document as the XML an analysis service answers with."""
    return _derived(spark, sf_dir, "xml", derived_xml)


def rules() -> Rules:
    return Rules(seeds=SEEDS, negation=NEGATION, adversative=ADVERSATIVE)


def sentiment_vocabulary(candidates: DataFrame) -> DataFrame:
    """Distinct sentiment words: one to three characters."""
    valid = candidates.filter(sentiment_length_ok(F.col("sentiment")))
    return valid.select(F.col("sentiment.cont").alias("word")).distinct()


def lexicon(vocabulary: DataFrame) -> DataFrame:
    word = F.col("word")
    polarity = F.when(word.contains("a"), -1).when(word.contains("e"), 1)
    return vocabulary.withColumn("polarity", polarity).filter("polarity is not null")


def synonym_lines(vocabulary: DataFrame) -> DataFrame:
    """A line per group: the key, then its words in alphabetical order.

    The group is taken from a hash of the word, so no line holds more than a small part of
    the vocabulary.
    """
    grp = F.substring(F.md5(F.col("word").cast("binary")), 1, 3)
    words = F.array_join(F.sort_array(F.collect_list("word")), " ")
    return vocabulary.groupBy(grp.alias("grp")).agg(
        F.concat("grp", F.lit("= "), words).alias("value")
    )


def synonyms(vocabulary: DataFrame) -> DataFrame:
    return synonym_table(synonym_lines(vocabulary))


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task results: one page of at most ten turns per row, failed when the conversation id ends in 7."""
    page = F.floor(F.col("turn") / fixed.PAGE_SIZE)
    comment = F.struct(
        F.col("turn"),
        F.struct(
            F.col("text").alias("content"),
            (F.col("turn") % 5 + 1).cast("int").alias("score"),
        ).alias("c"),
    )
    failed = F.col("conv_id") % 10 == 7
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id", page.alias("page"))
        .agg(F.sort_array(F.collect_list(comment)).getField("c").alias("list"))
        .select(
            F.concat_ws("-", "conv_id", "page").alias("_id"),
            F.when(failed, "FAILURE").otherwise("SUCCESS").alias("status"),
            F.when(failed, "false").otherwise(F.to_json("list")).alias("result"),
            "conv_id",
            "page",
        )
    )


def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, and every third page fetched again seven hours later."""
    pages = table(spark, sf_dir, "pages")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = F.make_dt_interval(F.lit(0), F.col("page_id"))
    fetched = pages.select(
        "page_id",
        "url",
        "html",
        F.when(F.col("page_id") % 5 == 0, 503).otherwise(200).alias("code"),
        (first + hours).alias("fetched_at"),
    )
    again = fetched.filter(F.col("page_id") % 3 == 0).withColumns(
        {
            "html": F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("html")),
            "code": F.lit(200),
            "fetched_at": F.col("fetched_at") + F.expr("interval 7 hours"),
        }
    )
    return fetched.unionByName(again)
