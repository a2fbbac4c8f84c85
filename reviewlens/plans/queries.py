"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import schemas
from reviewlens.functions import text
from reviewlens.operators import bootstrap, classify, comments, evaluate, lexicon, negation
from reviewlens.operators import pairs as word_pairs
from reviewlens.operators import scoring, segment, tags
from reviewlens.plans import driver_tables as tables
from reviewlens.plans import product_opinions as opinions
from reviewlens.session import new_folder, shuffles_dropped, stage
from reviewlens.sources import parses, review_pages, tables as stored, text_files, web_pages
from reviewlens.sources.quarantine import Quarantine
from reviewlens.streaming import ingest

KEY = ["pId", "cId", "sId", "pairNo"]
CALLBACK = "cb"
PAGE_URL = "https://shop.example.com/reviews?callback=@&product=#&page=$&size=10"


# --- results, cleaning, ids -------------------------------------------------------------


def flatten_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = comments.flatten_results(tables.raw_comments(spark, sf))
    return rows.select("conv_id", "page", "pos", "content", "score")


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = comments.flatten_results(tables.raw_comments(spark, sf))
    numbered = comments.dense_ids(rows, ["conv_id", "page", "pos"])
    return numbered.select("cId", "conv_id", "page", "pos", "score")


def format_comments(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.raw_comments(spark, sf)
    return comments.format_comments(raw, F.lit(1000), ["conv_id", "page", "pos"])


def counter_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries are numbered one after the other, the second one twice: the numbers each got."""
    rows = comments.flatten_results(tables.raw_comments(spark, sf)).select("conv_id", "page", "pos", "content")
    counter = comments.Counter(spark, new_folder(spark, "counter"))
    given = []
    for part in (0, 1, 1, 2):
        numbered = comments.counter_ids(rows.filter(F.col("conv_id") % 3 == part), counter, f"part {part}")
        given.append(
            numbered.agg(
                F.lit(f"part {part}").alias("delivery"),
                F.count(F.lit(1)).alias("n"),
                F.count_distinct("cId").alias("n_ids"),
                F.min("cId").alias("first"),
                F.max("cId").alias("last"),
            )
        )
    return reduce(DataFrame.unionByName, given)


def normalise_newlines(spark: SparkSession, sf: str) -> DataFrame:
    documents = tables.table(spark, sf, "documents")
    return documents.select("doc_id", text.newlines_marked(F.col("text")).alias("content"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return segment.unspaced_runs(tables.table(spark, sf, "documents"), tables.unspaced(F.col("text")))


def run_words(spark: SparkSession, sf: str) -> DataFrame:
    """The word list counted from unspaced runs."""
    return segment.words_of_runs(_runs(spark, sf)).select("word", "n", "weight")


def segmented_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Unspaced runs cut by the three modes, with the word list counted from them."""
    runs = _runs(spark, sf)
    with shuffles_dropped(spark):
        words = stage(segment.words_of_runs(runs), "run-words")
    cut = segment.segmented(runs, None, words)
    return cut.select("run", "n", *[F.array_join(mode, "/").alias(mode) for mode in ("precise", "full", "search")])


def repeat_ratio(spark: SparkSession, sf: str) -> DataFrame:
    documents = tables.table(spark, sf, "documents").select("doc_id", "text")
    ratio = text.repeat_ratio(text.tokens_precise(F.col("text")))
    return tables.spread(documents, "doc_id").select("doc_id", ratio.alias("ratio"))


def purge_comments(spark: SparkSession, sf: str) -> DataFrame:
    return comments.purge(tables.sentences(spark, sf)).select("pId", "cId", "sId", "content")


def element_check(spark: SparkSession, sf: str) -> DataFrame:
    clean = comments.purge(tables.sentences(spark, sf), check_elements=True)
    return clean.select("pId", "cId", "sId", "content")


# --- sources ----------------------------------------------------------------------------


def _callback_pages(spark: SparkSession, sf: str) -> DataFrame:
    raw = comments.successful(tables.raw_comments(spark, sf))
    page = F.concat(F.lit('cb({"comments":'), "result", F.lit("});"))
    return raw.select("conv_id", "page", page.alias("body"))


def jsonp_comments(spark: SparkSession, sf: str) -> DataFrame:
    return review_pages.page_comments(_callback_pages(spark, sf), "body")


def gbk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Callback pages as GBK bytes, their plain letters written with CJK characters, read back."""
    plain = "".join(chr(ord("a") + i) for i in range(26))
    cjk = "".join(chr(0x4E00 + i) for i in range(26))
    written = F.regexp_replace(F.translate("body", plain, cjk), r"[^\x00-\x7f\u4e00-\u9fff]", "?")
    # the names of the fields stay as they are
    for field in ("comments", "content", "score"):
        written = F.replace(written, F.translate(F.lit(f'"{field}"'), plain, cjk), F.lit(f'"{field}"'))
    # and so do the escaped line breaks
    written = F.regexp_replace(written, r"\\" + cjk[plain.index("n")], r"\\n")
    pages = review_pages.encoded(_callback_pages(spark, sf).withColumn("body", written), "body")
    return review_pages.page_comments(review_pages.decoded(pages, "body"), "body")


def _clause_digest(clauses: DataFrame) -> DataFrame:
    def joined(name: str) -> Column:
        return F.array_join(F.col("words").getField(name).cast("array<string>"), " ")

    return clauses.select(
        "pId",
        "cId",
        "sId",
        F.size("words").alias("n_words"),
        joined("id").alias("ids"),
        joined("cont").alias("text"),
        joined("pos").alias("pos"),
        joined("parent").alias("parents"),
        joined("relate").alias("relates"),
    )


def xml_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = tables.comments_xml(spark, sf).select("pId", "cId", parses.xml_clauses(F.col("xml")).alias("cDpResult"))
    return _clause_digest(parses.flat_clauses(parsed))


def xml_sentence_map(spark: SparkSession, sf: str) -> DataFrame:
    by_comment = parses.xml_by_comment(F.col("cId"), F.col("xml"))
    return (
        tables.comments_xml(spark, sf)
        .select(F.explode(by_comment).alias("cId", "sentences"))
        .select(
            "cId",
            F.size("sentences").alias("n_sentences"),
            F.size(F.flatten("sentences")).alias("n_words"),
        )
    )


def task_parses(spark: SparkSession, sf: str) -> DataFrame:
    """Word ids travel as text inside the result, as attributes of a parse do."""
    text_words = schemas.CLAUSE_LIST.replace("int", "string")
    raw = tables.comments_dp(spark, sf).select(
        F.when(F.col("cId") % 10 == 7, "FAILURE").otherwise("SUCCESS").alias("status"),
        F.to_json(
            F.struct("pId", "cId", F.col("cDpResult").cast(text_words).alias("cDpResult"))
        ).alias("result"),
    )
    return _clause_digest(parses.flat_clauses(parses.task_parses(raw)))


def json_first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform("cDpResult", lambda s: s["sDpResult"])
    answers = tables.comments_dp(spark, sf).select("cId", F.to_json(F.array(words)).alias("answer"))
    first = parses.json_first_sentence(F.col("answer"))
    return answers.select("cId", F.array_join(first.getField("cont"), " ").alias("text"))


def skipped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Left-out rows by source and reason: results that failed, are empty, cut off or without a
    comment, cut-off XML, and opinions whose clause is missing."""
    kept = Quarantine(spark)
    text_words = schemas.CLAUSE_LIST.replace("int", "string")
    c_id = F.when(F.col("cId") % 17 != 9, F.col("cId")).alias("cId")
    whole = F.to_json(F.struct("pId", c_id, F.col("cDpResult").cast(text_words).alias("cDpResult")))
    cut_off = F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))
    raw = tables.comments_dp(spark, sf).select(
        F.when(F.col("cId") % 10 == 7, "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(F.col("cId") % 13 == 5, "false")
        .when(F.col("cId") % 11 == 3, cut_off)
        .otherwise(whole)
        .alias("result"),
    )
    read = [parses.flat_clauses(parses.sifted_task_parses(raw, kept)).count()]
    xml = F.when(F.col("cId") % 9 == 4, F.substring("xml", F.lit(1), F.length("xml") - 20)).otherwise(F.col("xml"))
    documents = tables.comments_xml(spark, sf).withColumn("xml", F.when(F.col("cId") % 19 != 6, xml))
    read.append(parses.flat_clauses(parses.sifted_xml_clauses(documents, "xml", kept)).count())
    found = _mined(spark, sf).opinions().select("pId", "cId", "sId", "pairNo")
    clauses = tables.clauses(spark, sf).filter((F.col("cId") + F.col("sId")) % 17 != 0)
    orphans = negation.opinions_without_clause(found, clauses)
    key = F.concat_ws("-", "pId", "cId", "sId", "pairNo")
    kept.add(orphans.select(F.lit("no clause").alias("reason"), key.alias("key"), F.lit(None).alias("record")), "opinions")
    clauses_read = spark.createDataFrame(
        [("task results", "clauses read", read[0]), ("xml parses", "clauses read", read[1])],
        "source string, reason string, n bigint",
    )
    return kept.account().unionByName(clauses_read)


def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pages laid out like a comment list, then read back."""
    rows = comments.flatten_results(tables.raw_comments(spark, sf))
    escaped = F.col("content")
    for character, reference in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        escaped = F.replace(escaped, F.lit(character), F.lit(reference))
    mark = F.when(
        F.col("pos") % 3 > 0,
        F.concat(F.lit('<span class="allstar'), "score", F.lit('0 rating" title=""></span>')),
    ).otherwise("")
    block = F.concat(
        F.lit('<div class="comment"><h3><span class="comment-vote"><span class="votes">'),
        F.col("conv_id") + F.col("pos"),
        F.lit('</span></span><span class="comment-info">'),
        mark,
        F.lit('</span></h3><p class="">'),
        escaped,
        F.lit("</p></div>\n"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("pos", block.alias("block"))))
    pages = rows.groupBy("conv_id", "page").agg(
        F.concat(
            F.lit('<html><body><div class="comment">not listed</div><div id="comments">'),
            F.array_join(in_order.getField("block"), ""),
            F.lit("</div></body></html>"),
        ).alias("html")
    )
    return web_pages.html_comments(pages, "html")


#: Text as it is written in a page, and as it reads.
REFERENCES = [
    ("&#38;lt;", "&lt;"),
    ("&amp;lt;", "&lt;"),
    ("&#x41;&#X0042;", "AB"),
    ("&#128512;", chr(128512)),
    ("&#55357;&#56832;", "&#55357;&#56832;"),
    ("&#99999999;", "&#99999999;"),
    ("&#xffffffffff;", "&#xffffffffff;"),
    ("&#0;", "&#0;"),
    ("&unknown; & &", "&unknown; & &"),
    ("<b>&lt;b&gt;</b>", "<b>"),
    ("&quot;&apos;&nbsp;", "\"' "),
]


def html_references(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the documents, escaped, each with one of the odd references behind it."""
    documents = tables.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    escaped = F.col("content")
    for character, reference in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        escaped = F.replace(escaped, F.lit(character), F.lit(reference))
    written = F.array(*[F.lit(html) for html, _ in REFERENCES])
    html = F.concat(F.lit("<p>"), escaped, F.lit(" "), F.get(written, F.col("doc_id") % len(REFERENCES)), F.lit("</p>"))
    return documents.select("doc_id", web_pages.text_content(html).alias("content"))


def page_plan(spark: SparkSession, sf: str) -> DataFrame:
    pId = tables.product_of(F.col("source"))
    products = (
        tables.table(spark, sf, "documents")
        .groupBy(pId.alias("pId"))
        .agg(F.count(F.lit(1)).alias("maxsize"))
        .withColumn("callback", F.concat(F.lit(CALLBACK), "pId"))
    )
    return web_pages.page_plan(products, PAGE_URL)


def set_query_param(spark: SparkSession, sf: str) -> DataFrame:
    url = web_pages.set_query_parameter(F.col("url"), "page", F.col("page_id"))
    return tables.table(spark, sf, "pages").select("page_id", url.alias("url"))


def _now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def latest_pages(spark: SparkSession, sf: str) -> DataFrame:
    latest = web_pages.latest_pages(tables.page_cache(spark, sf), _now())
    fetched_at = F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at")
    return latest.select("url", "page_id", "code", F.length("html").alias("n_chars"), fetched_at)


def upserted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The page cache brought together from three deliveries, the second one run twice."""
    path, cache = new_folder(spark, "page-cache"), tables.page_cache(spark, sf)
    for part in (0, 1, 1, 2):
        web_pages.upsert_pages(spark, path, cache.filter(F.col("page_id") % 3 == (part + 1) % 3))
    schema = cache.withColumn("bucket", F.lit(0)).schema
    stored = web_pages.read_pages(spark, path, schema)
    fetched_at = F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at")
    return stored.select("url", "page_id", "code", F.length("html").alias("n_chars"), fetched_at)


def cached_pages(spark: SparkSession, sf: str) -> DataFrame:
    urls = tables.table(spark, sf, "pages").select("page_id", "url")
    latest = web_pages.latest_pages(tables.page_cache(spark, sf), _now())
    return web_pages.cached(urls, latest).select("page_id", "url")


def fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    urls = tables.table(spark, sf, "pages").select("page_id", "url")
    latest = web_pages.latest_pages(tables.page_cache(spark, sf), _now())
    return web_pages.fetch_plan(urls, latest).select("page_id", "url", "reason")


def export_rated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return text_files.rated_lines(tables.comments(spark, sf), "score", "content")


# --- pairs ------------------------------------------------------------------------------


def _flat_pair(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *KEY,
        F.col("first.id").alias("first_id"),
        F.col("first.cont").alias("first"),
        F.col("second.id").alias("second_id"),
        F.col("second.cont").alias("second"),
        "relate",
        *more,
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return word_pairs.dependency_pairs(tables.clauses(spark, sf))


def _pairs_of_kind(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _flat_pair(_pairs(spark, sf).filter(F.col("kind") == kind))

    return query


def dep_pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_pair(_pairs(spark, sf), "kind")


def flat_pairs_view(spark: SparkSession, sf: str) -> DataFrame:
    """The nested pair table, stored as JSON text, read back and flattened."""
    nested = word_pairs.comment_pairs(tables.comments_dp(spark, sf))
    text_form = stored.with_json_columns(nested, "cDpPairs")
    typed = stored.from_json_column(text_form, "cDpPairs", schemas.PAIR_LIST)
    return _flat_pair(word_pairs.flat_pairs(typed))


def _opinion(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *KEY,
        F.col("feature.cont").alias("feature"),
        F.col("sentiment.cont").alias("sentiment"),
        "relate",
        *more,
    )


def seed_pass(spark: SparkSession, sf: str) -> DataFrame:
    pairs = word_pairs.with_sides(_pairs(spark, sf))
    return _opinion(bootstrap.seed_pass(pairs, tables.SEEDS), "label")


# --- bootstrapping ----------------------------------------------------------------------


def _mined(spark: SparkSession, sf: str) -> opinions.Mined:
    return opinions.mine(tables.clauses(spark, sf), tables.rules())


def bootstrap_labels(spark: SparkSession, sf: str) -> DataFrame:
    def word(side: str) -> Column:
        return F.struct(f"{side}.cont", f"{side}.pos").alias(side)

    sides = word_pairs.with_sides(_pairs(spark, sf))
    pairs = stage(sides.select(*KEY, word("feature"), word("sentiment"), "relate"), "pairs")
    labelled = bootstrap.bootstrap(pairs, tables.SEEDS)
    return _opinion(bootstrap.label_pairs(pairs, labelled), "label")


def grown_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Word pairs of half of the documents, labelled again as the other half comes to them."""
    found = stage(
        word_pairs.opinion_candidates(
            tables.clauses(spark, sf), tables.SEEDS, tables.NEGATION, tables.ADVERSATIVE
        ),
        "candidates",
    )
    first, second = (
        stage(bootstrap.word_edges(found.filter(F.col("cId") % 2 == half), tables.SEEDS), "edges")
        for half in (0, 1)
    )
    both = stage(bootstrap.merged_edges(first, second), "edges")
    times = bootstrap.extended_times(bootstrap.discovery_times(first), both, second)
    return bootstrap.label_edges(both, times).filter("s is not null").drop("by")


def feature_sentiment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _opinion(_mined(spark, sf).opinions())


def nested_opinions(spark: SparkSession, sf: str) -> DataFrame:
    nested = bootstrap.nest_opinions(_mined(spark, sf).opinions())

    def clause(s: Column) -> Column:
        pairs = F.transform(
            s["sFeaSenPairs"],
            lambda o: F.concat_ws("-", o["feature"]["cont"], o["sentiment"]["cont"], o["relate"]),
        )
        return F.concat(s["sId"].cast("string"), F.lit(":"), F.array_join(pairs, ","))

    return nested.select(
        "pId", "cId", F.array_join(F.transform("cFeaSenPairs", clause), ";").alias("opinions")
    )


def feature_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf).feature_words()


def sentiment_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf).sentiment_words()


# --- negation ---------------------------------------------------------------------------


def negation_words(spark: SparkSession, sf: str) -> DataFrame:
    return _with_negation(_mined(spark, sf).opinions())


def _with_negation(df: DataFrame) -> DataFrame:
    return _opinion(
        df.withColumns({"neg_id": F.col("neg_adv.id"), "neg_word": F.col("neg_adv.cont")}),
        "neg_id",
        "neg_word",
    )


def clause_context(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions and parses as two stored tables, joined by clause."""
    found = _mined(spark, sf).opinions().drop("neg_adv", "adversative")
    joined = negation.with_clause_context(
        found, tables.clauses(spark, sf), tables.NEGATION, tables.ADVERSATIVE
    )
    return _with_negation(negation.after_last_adversative(joined))


def adversative_reset(spark: SparkSession, sf: str) -> DataFrame:
    return _opinion(_mined(spark, sf).tuples())


def negated_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return _with_negation(negation.negated(_mined(spark, sf).tuples()))


# --- lexicons and scores ----------------------------------------------------------------


def clean_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents, their plain letters written with CJK characters. Words of the
    first list that keep other characters drop out, those of the second list stay."""
    plain = "".join(chr(ord("a") + i) for i in range(26))
    cjk = "".join(chr(0x4E00 + i) for i in range(26))

    def lines(df: DataFrame) -> DataFrame:
        written = F.translate(F.lower(F.col("text")), plain, cjk)
        return df.select(F.explode(F.split(written, "[ \n]")).alias("value"))

    documents = tables.table(spark, sf, "documents").select("doc_id", "text")
    return lexicon.build_word_list(
        [lines(tables.spread(documents, "doc_id"))], [lines(tables.table(spark, sf, "benchmark"))]
    )


def word_list_files(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents with an a and with an e, written as two text files and read as a lexicon."""
    documents = tables.spread(tables.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = documents.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).distinct()
    paths = [new_folder(spark, f"{letter}-words") for letter in "ae"]
    for letter, path in zip("ae", paths):
        text_files.write_lines(words.filter(F.col("word").contains(letter)), "word", path)
    return lexicon.read_lexicon(spark, *paths)


def _dictionaries(mined: opinions.Mined) -> tuple[DataFrame, DataFrame]:
    vocabulary = stage(tables.sentiment_vocabulary(mined.candidates), "vocabulary")
    return tables.lexicon(vocabulary), tables.synonyms(vocabulary)


def synonym_polarity(spark: SparkSession, sf: str) -> DataFrame:
    candidates = word_pairs.opinion_candidates(
        tables.clauses(spark, sf), tables.SEEDS, tables.NEGATION, tables.ADVERSATIVE
    )
    vocabulary = stage(tables.sentiment_vocabulary(candidates), "vocabulary")
    return scoring.word_polarity(tables.lexicon(vocabulary), tables.synonyms(vocabulary))


def _degrees(spark: SparkSession, sf: str) -> DataFrame:
    mined = _mined(spark, sf)
    return opinions.score(mined, *_dictionaries(mined))


def tuple_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return _opinion(_degrees(spark, sf), "deg_value")


def comment_degree(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.comment_degrees(_degrees(spark, sf))


def flat_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return _opinion(scoring.polar(_degrees(spark, sf)), "deg_value")


def flat_degrees_view(spark: SparkSession, sf: str) -> DataFrame:
    """The nested score table, stored as JSON text, read back and flattened."""
    nested = scoring.nest_degrees(_degrees(spark, sf))
    text_form = stored.with_json_columns(nested, "cDegrees")
    typed = stored.from_json_column(text_form, "cDegrees", schemas.DEGREE_LIST)
    return scoring.flat_degrees(typed).select(
        "pId",
        "cId",
        "sId",
        F.col("feature.cont").alias("feature"),
        F.col("sentiment.cont").alias("sentiment"),
        F.col("neg_adv.cont").alias("neg_word"),
        "relate",
        "deg_value",
    )


# --- reports ----------------------------------------------------------------------------


def _report(spark: SparkSession, sf: str) -> opinions.Report:
    mined = _mined(spark, sf)
    return opinions.report(mined, *_dictionaries(mined))


def classification_quality(spark: SparkSession, sf: str) -> DataFrame:
    degrees = scoring.comment_degrees(_degrees(spark, sf))
    return evaluate.classification_quality(degrees, tables.comments(spark, sf))


def feature_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).feature_tags()


def tag_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).tag_comments()


def hot_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).hot_tags()


def merged_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tags of two deliveries of comments, counted apart and merged without reading them again."""
    found = _report(spark, sf)
    polar = scoring.polar(found.degrees)
    parts = [tags.tag_counts(polar.filter(F.col("cId") % 2 == half)) for half in (0, 1)]
    return tags.tags_of_counts(tags.merged_counts(*parts), found.features)


def product_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).product_totals()


def append_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of all products stored by product, those of every second one stored again, read back."""
    totals = stage(_report(spark, sf).product_totals(), "totals")
    path = new_folder(spark, "summaries")
    stored.append_table(totals.filter(F.col("pId") % 2 == 0), path, partition_by=["pId"])
    stored.append_table(totals.filter(F.col("pId") % 2 == 1), path, partition_by=["pId"])
    stored.replace_partitions(totals.filter(F.col("pId") % 2 == 1), path, ["pId"])
    copy = new_folder(spark, "summaries")
    for _ in range(2):
        stored.overwrite_table(stored.read_table(spark, path, schema=totals.schema), copy)
    return stored.read_table(spark, copy, schema=totals.schema).select(*totals.columns)


def _shown(report: opinions.Report) -> DataFrame:
    """The summary documents, hot tags written as text in rank order."""

    def shown(hot: str) -> Column:
        line = F.transform(
            hot,
            lambda t: F.concat_ws(
                "/",
                t["tFeature"],
                t["tSentiment"],
                t["tCount"].cast("string"),
                t["tCommentCount"].cast("string"),
            ),
        )
        return F.array_join(line, ",")

    return report.product_summary().select(
        "pId",
        "productCommentSummary.*",
        shown("hotPosTagStatistics").alias("hotPos"),
        shown("hotNegTagStatistics").alias("hotNeg"),
    )


def product_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_report(spark, sf))


def reviews_to_summary(spark: SparkSession, sf: str) -> DataFrame:
    """From raw comments to summaries: every sentence is a comment, noise is purged, what is left is
    numbered over all products, parsed, mined, scored and summed up."""
    clean = comments.purge(tables.sentences(spark, sf))
    numbered = comments.dense_ids(clean, ["pId", "cId", "sId"], "number")
    mined = opinions.mine(tables.parsed_comments(numbered), tables.rules())
    return _shown(opinions.report(mined, *_dictionaries(mined)))


# --- classifier -------------------------------------------------------------------------


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    return classify.rated_text(export_rated_lines(spark, sf))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rated = tables.comments(spark, sf).select("cId", F.col("content").alias("text"))
    return classify.tokenized(rated)


def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return classify.word_count(_tokens(spark, sf))


def stop_words(spark: SparkSession, sf: str) -> DataFrame:
    return classify.stop_words(_tokens(spark, sf))


def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = classify.without_stop_words(_tokens(spark, sf))
    return kept.select("cId", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("kept"))


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return classify.balanced(_rated(spark, sf)).select("rating", "label", F.md5("text").alias("hash"))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = classify.term_weights(stage(_tokens(spark, sf), "tokens"), "cId")
    return weights.withColumn("tfidf", F.round("tfidf", 6))


def svm_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classify.train_and_test(_rated(spark, sf), "svm")


def naive_bayes_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classify.train_and_test(_rated(spark, sf), "naive_bayes")


def _bayes_data(spark: SparkSession, sf: str) -> DataFrame:
    balanced = stage(classify.tokenized(classify.balanced(_rated(spark, sf))), "tokens")
    return stage(classify.without_stop_words(balanced).select("text", "tokens", "label"), "data")


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    data = _bayes_data(spark, sf)
    part = F.when(classify.in_training(F.col("text")), "training").otherwise("test")
    return data.groupBy("label", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def bayes_weights(spark: SparkSession, sf: str) -> DataFrame:
    data = _bayes_data(spark, sf)
    model = classify.fit_bayes(data.filter(classify.in_training(F.col("text"))))
    return model.weights.select("word", F.round("negative", 6).alias("negative"), F.round("positive", 6).alias("positive"))


def bayes_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    data = _bayes_data(spark, sf)
    training = classify.in_training(F.col("text"))
    found = classify.bayes_predictions(classify.fit_bayes(data.filter(training)), data.filter(~training))
    right = F.count_if(F.col("prediction") == F.col("label"))
    return found.agg(F.count(F.lit(1)).alias("n_test"), right.alias("n_right"), (right / F.count(F.lit(1))).alias("accuracy"))


def score_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A model trained on the rated comments scores all documents."""
    data = stage(
        classify.without_stop_words(
            stage(classify.tokenized(classify.balanced(_rated(spark, sf))), "tokens")
        ).select("tokens", F.col("label").cast("double")),
        "data",
    )
    documents = tables.table(spark, sf, "documents").select("doc_id", "text")
    new = classify.tokenized(tables.spread(documents, "doc_id"), text.tokens_search)
    return classify.score(classify.fit(data), new).select("doc_id", "prediction")


# --- stream -----------------------------------------------------------------------------


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Task results as files, every fourth one delivered twice, ingested until none is left."""
    raw = tables.raw_comments(spark, sf)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id"))
    results = raw.select("_id", "status", "result", at.alias("fetched_at"), "conv_id")
    twice = results.unionByName(results.filter(F.col("conv_id") % 4 == 0)).drop("conv_id")
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "clean")
    twice.write.json(inbox)
    query = ingest.start_ingest(
        ingest.result_stream(spark, inbox), out, new_folder(spark, "progress")
    )
    query.awaitTermination()
    clean = spark.read.schema("_id string, pos int, content string, score int").parquet(out)
    return clean.select("_id", "pos", "content", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flatten_results": flatten_results,
    "assign_ids": assign_ids,
    "format_comments": format_comments,
    "counter_ids": counter_ids,
    "normalise_newlines": normalise_newlines,
    "repeat_ratio": repeat_ratio,
    "run_words": run_words,
    "segmented_runs": segmented_runs,
    "purge_comments": purge_comments,
    "element_check": element_check,
    "jsonp_comments": jsonp_comments,
    "gbk_pages": gbk_pages,
    "xml_parse": xml_parse,
    "xml_sentence_map": xml_sentence_map,
    "task_parses": task_parses,
    "json_first_sentence": json_first_sentence,
    "skipped_rows": skipped_rows,
    "html_fields": html_fields,
    "html_references": html_references,
    "page_plan": page_plan,
    "set_query_param": set_query_param,
    "latest_pages": latest_pages,
    "upserted_pages": upserted_pages,
    "cached_pages": cached_pages,
    "fetch_plan": fetch_plan,
    "export_rated_lines": export_rated_lines,
    "dep_pairs_base": _pairs_of_kind("base"),
    "dep_pairs_coo_dependent": _pairs_of_kind("dependent"),
    "dep_pairs_coo_head": _pairs_of_kind("head"),
    "dep_pairs_cross": _pairs_of_kind("cross"),
    "dep_pairs_all": dep_pairs_all,
    "flat_pairs_view": flat_pairs_view,
    "seed_pass": seed_pass,
    "bootstrap_labels": bootstrap_labels,
    "grown_labels": grown_labels,
    "feature_sentiment_pairs": feature_sentiment_pairs,
    "nested_opinions": nested_opinions,
    "feature_lexicon": feature_lexicon,
    "sentiment_lexicon": sentiment_lexicon,
    "negation_words": negation_words,
    "clause_context": clause_context,
    "adversative_reset": adversative_reset,
    "negated_tuples": negated_tuples,
    "clean_lexicon": clean_lexicon,
    "word_list_files": word_list_files,
    "synonym_polarity": synonym_polarity,
    "tuple_degrees": tuple_degrees,
    "comment_degree": comment_degree,
    "flat_degrees": flat_degrees,
    "flat_degrees_view": flat_degrees_view,
    "classification_quality": classification_quality,
    "feature_tags": feature_tags,
    "merged_tags": merged_tags,
    "tag_comments": tag_comments,
    "hot_tags": hot_tags,
    "product_totals": product_totals,
    "append_summaries": append_summaries,
    "product_summary": product_summary,
    "reviews_to_summary": reviews_to_summary,
    "word_count": word_count,
    "stop_words": stop_words,
    "stopword_filter": stopword_filter,
    "balanced_sample": balanced_sample,
    "tfidf_weights": tfidf_weights,
    "split_counts": split_counts,
    "bayes_weights": bayes_weights,
    "bayes_accuracy": bayes_accuracy,
    "svm_accuracy": svm_accuracy,
    "naive_bayes_accuracy": naive_bayes_accuracy,
    "score_texts": score_texts,
    "stream_ingest": stream_ingest,
}
