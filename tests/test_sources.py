import datetime
import time

from pyspark.sql import functions as F

from reviewlens import schemas
from reviewlens.functions import text
from reviewlens.operators import classify, comments, lexicon
from reviewlens.session import new_folder
from reviewlens.sources import parses, review_pages, tables, text_files, web_pages
from reviewlens.streaming import ingest


def contents(spark, values):
    return spark.createDataFrame([(v,) for v in values], "content string")


def kept(spark, values, **options):
    return [r.content for r in comments.purge(contents(spark, values), **options).collect()]


def test_purge_length_and_url(spark):
    long = lambda n: "".join(chr(0x4E00 + i) for i in range(n))
    assert kept(spark, [long(3), long(4), long(100), long(101), None]) == [long(4), long(100)]
    assert kept(spark, ["see http://a.cn/x now", "see a.cn now"]) == ["see a.cn now"]


def test_purge_repeats(spark):
    assert kept(spark, ["a a a b", "a a a a b"]) == ["a a a b"]
    ratio = text.repeat_ratio(F.split("content", " "))
    assert contents(spark, ["a/b x"]).select(ratio).first()[0] == 0.0
    assert contents(spark, ["a/a/a/b"]).select(ratio).first()[0] == 0.5


def test_element_check_is_optional(spark):
    assert kept(spark, ["abc 12!", "abc 好的"]) == ["abc 12!", "abc 好的"]
    assert kept(spark, ["abc 12!", "abc 好的"], check_elements=True) == ["abc 好的"]


def test_tokenisers(spark):
    row = contents(spark, ["手机很好用 iPhone7 好"]).select(
        text.tokens_precise(F.col("content")).alias("p"),
        text.tokens_full(F.col("content")).alias("f"),
        text.tokens_search(F.col("content")).alias("s"),
    ).first()
    assert row.p == ["手机", "很好", "用", "iPhone7", "好"]
    assert row.f == ["手机", "机很", "很好", "好用", "iPhone7", "好"]
    assert row.s == ["手", "机", "很", "好", "用", "手机", "机很", "很好", "好用", "iPhone7", "好"]


def test_search_tokens_keep_repeats(spark):
    row = contents(spark, ["好好好 好"]).select(text.tokens_search(F.col("content")).alias("s")).first()
    assert row.s == ["好", "好", "好", "好好", "好好", "好"]


def test_dense_ids(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    rows = comments.dense_ids(df, ["k"], "n", start=1).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 5001))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_format_comments(spark):
    raw = spark.createDataFrame(
        [
            ("a", "SUCCESS", '[{"content":"x","score":5},{"content":"y","score":1}]'),
            ("b", "FAILURE", '[{"content":"z","score":5}]'),
            ("c", "SUCCESS", "false"),
            ("d", "SUCCESS", '[{"content":"w","score":3}]'),
        ],
        schemas.RAW_COMMENTS,
    )
    rows = comments.format_comments(raw, F.lit(7), ["_id", "pos"]).orderBy("cId").collect()
    assert [(r.pId, r.cId, r.content, r.score) for r in rows] == [(7, 0, "x", 5), (7, 1, "y", 1), (7, 2, "w", 3)]


def test_callback_page(spark):
    pages = spark.createDataFrame(
        [('cb({"comments":[{"content":"true x\\n(y)","score":5}]});',)], "body string"
    )
    row = review_pages.page_comments(pages, "body").collect()
    assert [(r.pos, r.content, r.score) for r in row] == [(0, "true x。(y)", 5)]
    row = review_pages.page_comments(pages, "body", mark_newlines=False).first()
    assert row.content == "true x\n(y)"


def test_gbk(spark):
    df = spark.createDataFrame([(bytearray("屏幕很好".encode("gbk")),)], "b binary")
    assert review_pages.decoded(df, "b").first()[0] == "屏幕很好"


XML = (
    '<xml4nlp><doc><para id="0"><sent id="0" cont="a"><word id="0" cont="屏幕" pos="n" ne="O" parent="2" '
    'relate="SBV"/></sent></para><para id="1"><sent id="1" cont="b"></sent></para></doc></xml4nlp>'
)


def test_parse_xml(spark):
    df = spark.createDataFrame([(1, XML), (2, "<broken")], "cId bigint, xml string")
    rows = df.select("cId", parses.xml_clauses(F.col("xml")).alias("c")).orderBy("cId").collect()
    assert [(s.sId, [tuple(w) for w in s.sDpResult]) for s in rows[0].c] == [
        (0, [(0, "屏幕", "n", "O", 2, "SBV")]),
        (1, []),
    ]
    assert rows[1].c is None
    by_comment = df.limit(1).select(parses.xml_by_comment(F.col("cId"), F.col("xml"))).first()[0]
    assert [len(s) for s in by_comment[1]] == [1, 0]


def test_parse_results(spark):
    good = '{"pId":1,"cId":2,"cDpResult":[{"sId":0,"sDpResult":[{"id":"0","cont":"好","pos":"a","ne":"O","parent":"-1","relate":"HED"}]}]}'
    raw = spark.createDataFrame([("SUCCESS", good), ("SUCCESS", "false"), ("FAILURE", good)], schemas.RAW_PARSES)
    row = parses.flat_clauses(parses.task_parses(raw)).collect()
    assert [(r.pId, r.cId, r.sId, [tuple(w) for w in r.words]) for r in row] == [
        (1, 2, 0, [(0, "好", "a", "O", -1, "HED")])
    ]
    first = spark.createDataFrame([('[[[{"id":0,"cont":"好"}],[]]]',), ("[]",)], "j string")
    found = [r[0] for r in first.select(parses.json_first_sentence(F.col("j"))).collect()]
    assert found[0][0].cont == "好" and found[1] is None


def test_html_comments(spark):
    html = """<div id="comments">
      <div class="comment"><h3><span class="comment-vote"><span class="votes">12</span></span>
        <span class="comment-info"><span class="allstar40 rating" title=""></span></span></h3>
        <p class="">good &amp; <b>big</b> &lt;3 &#22909;</p></div>
      <div class="comment "><h3><span class="votes">x</span></h3><p>plain</p></div></div>"""
    df = spark.createDataFrame([(1, html), (2, "<p>no list</p>")], "page_id int, html string")
    rows = web_pages.html_comments(df, "html").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 12, 4, "good & big <3 好"), (1, 1, None, 0, "plain")]


def test_addresses(spark):
    products = spark.createDataFrame([(7, "cb", 25), (8, "cb", 9)], "pId bigint, callback string, maxsize int")
    rows = web_pages.page_plan(products, "http://x?callback=@&productId=#&page=$").orderBy("page").collect()
    assert [r.url for r in rows] == [f"http://x?callback=cb&productId=7&page={i}" for i in range(2)]
    urls = ["http://a/b?start=0&limit=20&x=#f", "http://a/b", "http://a/b?start=1&start=2"]
    df = contents(spark, urls).select(web_pages.set_query_parameter(F.col("content"), "start", F.lit("4 0")))
    assert [r[0] for r in df.collect()] == [
        "http://a/b?limit=20&start=4+0#f", "http://a/b?start=4+0", "http://a/b?start=4+0",
    ]


def test_page_cache(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    cache = spark.createDataFrame(
        [
            ("old", "x", 200, datetime.datetime(2023, 11, 1)),
            ("ok", "", 503, day(1)),
            ("ok", "x", 200, day(2)),
            ("error", "x", 503, day(2)),
            ("empty", "", 200, day(2)),
        ],
        schemas.PAGE_CACHE,
    )
    latest = web_pages.latest_pages(cache, F.lit(day(20)))
    assert {(r.url, r.code) for r in latest.collect()} == {("ok", 200), ("error", 503), ("empty", 200)}
    urls = spark.createDataFrame([("old",), ("ok",), ("error",), ("empty",)], "url string")
    plan = lambda n: {(r.url, r.reason) for r in web_pages.fetch_plan(urls, latest, n).collect()}
    assert plan(1) == {("old", "uncached"), ("error", "server error"), ("empty", "empty")}
    assert plan(0) == {("old", "uncached"), ("empty", "empty")}
    assert {r.url for r in web_pages.cached(urls, latest).collect()} == {"ok", "error", "empty"}


def test_tables_and_text(spark):
    path = new_folder(spark, "table")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pId bigint, v string")
    tables.append_table(df, path, partition_by=["pId"])
    tables.append_table(df, path, partition_by=["pId"])
    assert tables.read_table(spark, path, schema="pId bigint, v string").count() == 4
    path = new_folder(spark, "json")
    tables.overwrite_table(df, path, "json")
    tables.overwrite_table(df.limit(1), path, "json")
    assert tables.read_table(spark, path, "json", "pId bigint, v string").collect()[0].v == "a"
    path = new_folder(spark, "words")
    text_files.write_lines(df, "v", path)
    assert {r.value for r in text_files.read_lines(spark, path).collect()} == {"a", "b"}
    rows = spark.createDataFrame([(5, " good\nfilm "), (0, "bad")], "r int, t string")
    lines = [r.value for r in text_files.rated_lines(rows, "r", "t").collect()]
    assert lines == ["5\tgood film", "0\tbad"]


def test_word_lists(spark):
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    built = lexicon.build_word_list([lines(" 好 ", "好", "a好", "", "漂亮\r")], [lines("a好", "　差", "  ")])
    assert {r.word for r in built.collect()} == {"好", "漂亮", "a好", "差"}


def test_classifier_inputs(spark):
    lines = spark.createDataFrame(
        [("5\tgood one",), ("5\tgood one",), ("5\tfine",), ("4\tso so",), ("1\tbad",), ("x\tbad",), ("1\ta\tb",)],
        "value string",
    )
    rated = classify.rated_text(lines)
    assert rated.count() == 4
    rows = classify.balanced(rated).collect()
    assert sorted((r.rating, r.label) for r in rows) == [(1, 0), (5, 1)]
    tokens = classify.tokenized(spark.createDataFrame([("a b a c a",), ("a b",)], "text string"))
    assert [(r.word, r.n) for r in classify.word_count(tokens).collect()] == [("a", 4), ("b", 2), ("c", 1)]
    assert [r.word for r in classify.stop_words(tokens, 1).collect()] == ["a"]
    left = tokens.select(classify.without_words(F.col("tokens"), ["a"])).collect()
    assert [r[0] for r in left] == [["b", "c"], ["b"]]


def test_classifier_learns(spark):
    common = " ".join(f"common{i}" for i in range(10))  # the ten stop words
    lines = spark.createDataFrame(
        [(f"5\tnice lovely great item number{i} {common}",) for i in range(60)]
        + [(f"1\tawful broken useless thing code{i} {common}",) for i in range(60)],
        "value string",
    )
    rated = classify.rated_text(lines)
    for kind in ("svm", "naive_bayes"):
        assert classify.train_and_test(rated, kind).first().accuracy == 1.0


def test_stream_agrees_with_batch_and_drops_repeats(spark):
    rows = [
        (str(i), "SUCCESS" if i % 4 else "FAILURE", f'[{{"content":"text no{i}\\nnext","score":5}}]', datetime.datetime(2024, 1, 1))
        for i in range(20)
    ]
    results = spark.createDataFrame(rows, ingest.RESULTS)
    inbox, out, progress = (new_folder(spark, n) for n in ("inbox", "out", "progress"))
    results.write.json(inbox)
    read = lambda: sorted(
        (r._id, r.content) for r in spark.read.schema("_id string, content string").parquet(out).collect()
    )
    ingest.start_ingest(ingest.result_stream(spark, inbox), out, progress).awaitTermination()
    batch = sorted((r._id, r.content) for r in ingest.clean_comments(results).collect())
    assert read() == batch and len(batch) == 15 and "。" in batch[0][1]
    results.write.mode("append").json(inbox)
    ingest.start_ingest(ingest.result_stream(spark, inbox), out, progress).awaitTermination()
    assert read() == batch


def test_stream_loses_no_late_results(spark):
    """Old files that arrive last, one by one or together, in any order."""
    made = [
        (f"r{i}", "SUCCESS", f'[{{"content":"text number{i}","score":5}}]', datetime.datetime(2024, 6 if i < 3 else 1, 1 + i))
        for i in range(4)
    ]
    batch = sorted(r._id for r in ingest.clean_comments(spark.createDataFrame(made, ingest.RESULTS)).collect())
    for per_batch, order in ((1, [0, 1, 2, 3]), (1, [3, 2, 1, 0]), (1000, [0, 1, 2, 3])):
        inbox, out, progress = (new_folder(spark, n) for n in ("inbox", "out", "progress"))
        for i in order:
            spark.createDataFrame([made[i]], ingest.RESULTS).coalesce(1).write.mode("append").json(inbox)
            time.sleep(0.05)
        ingest.start_ingest(ingest.result_stream(spark, inbox, per_batch), out, progress).awaitTermination()
        assert sorted(r._id for r in spark.read.schema("_id string").parquet(out).collect()) == batch
