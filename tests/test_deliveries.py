"""Work that goes on from one delivery to the next, and rows that are left out."""

import datetime
import random

from pyspark.sql import functions as F

from reviewlens import schemas
from reviewlens.operators import bootstrap, classify, comments, tags
from reviewlens.session import new_folder, stage
from reviewlens.sources import parses, review_pages, tables, web_pages
from reviewlens.sources.quarantine import Quarantine
from reviewlens.streaming import ingest

EDGES = "pId bigint, f string, fpos string, s string, spos string, seed boolean, n bigint"


def random_edges(spark, seed, n):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        p, f, s = rng.randint(1, 2), rng.randint(0, 14), rng.randint(0, 14)
        # a word has one tag in most pairs, the rare others must not disturb
        key = (p, f"f{f}", "nvad"[(f + (rng.random() < 0.1)) % 4], f"s{s}", "aav"[s % 3], f == 0)
        rows[key] = rows.get(key, 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in rows.items()], EDGES)


def reached(times):
    return [sorted(map(tuple, side.select("pId", "word", "t").collect())) for side in times]


def walked(edges):
    """Times by walking from word to word."""
    known = {("s", e.pId, e.s): 0 for e in edges if e.seed and e.spos == "a"}
    last, t = list(known), 0
    while last:
        t += 1
        new = set()
        for side, p, word in last:
            for e in edges:
                if e.seed or e.pId != p:
                    continue
                if side == "s" and e.s == word and e.fpos in "nv":
                    new.add(("f", p, e.f))
                if side == "f" and e.f == word and e.spos == "a":
                    new.add(("s", p, e.s))
        last = [w for w in new if w not in known]
        known.update(dict.fromkeys(last, t))
    return [sorted((p, w, n) for (of, p, w), n in known.items() if of == side) for side in "fs"]


def test_rounds_find_what_walking_finds_and_read_less(spark):
    edges = stage(random_edges(spark, 3, 60), "edges")
    steps = []
    found = reached(bootstrap.discovery_times(edges, steps.append))
    assert found == walked(edges.collect())
    for parity in (0, 1):
        links = [s.links for s in steps[1:] if s.t % 2 == parity]
        assert links == sorted(links, reverse=True)
    assert sum(s.words for s in steps) == sum(map(len, found))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("links_")]


def test_new_edges_extend_the_times(spark):
    for seed in (1, 2):
        old, new = (stage(random_edges(spark, 10 * seed + k, 25), "edges") for k in (0, 1))
        both = stage(bootstrap.merged_edges(old, new), "edges")
        times = bootstrap.extended_times(bootstrap.discovery_times(old), both, new)
        assert reached(times) == walked(both.collect())


def test_nothing_new_and_nothing_before(spark):
    edges = stage(random_edges(spark, 5, 20), "edges")
    none = edges.limit(0)
    times = bootstrap.discovery_times(edges)
    assert reached(bootstrap.extended_times(times, edges, none)) == reached(times)
    assert reached(bootstrap.extended_times(bootstrap.discovery_times(none), edges, edges)) == reached(times)


def test_left_out_rows_are_kept_with_their_reason(spark):
    good = '{"pId":1,"cId":2,"cDpResult":[{"sId":"0","sDpResult":[{"id":"0","cont":"a","parent":"-1"}]}]}'
    rows = [("SUCCESS", good), ("SUCCESS", good[:-9]), ("FAILURE", good), (None, good), ("SUCCESS", None)]
    rows += [("SUCCESS", "false"), ("SUCCESS", " "), ("SUCCESS", '{"pId":1}'), ("SUCCESS", "[1"), ("SUCCESS", good)]
    kept = Quarantine(spark)
    assert kept.account().count() == 0
    found = parses.sifted_task_parses(spark.createDataFrame(rows, "status string, result string"), kept)
    assert [(r.pId, r.cId, r.cDpResult[0].sDpResult[0].cont) for r in found.collect()] == [(1, 2, "a")] * 2
    account = {(r.source, r.reason): r.n for r in kept.account().collect()}
    assert account == {("task results", k): n for k, n in (("failed", 2), ("empty", 3), ("broken", 2), ("no comment", 1))}
    assert {r.record for r in kept.table().filter("reason = 'broken'").collect()} == {good[:-9], "[1"}
    xml = '<xml4nlp><doc><para id="0"><sent id="0"><word id="0" cont="a" pos="n"/></sent></para></doc></xml4nlp>'
    documents = spark.createDataFrame([(1, 1, xml), (1, 2, xml[:-12]), (1, 3, None), (1, 4, "")], "pId bigint, cId bigint, xml string")
    found = parses.sifted_xml_clauses(documents, "xml", kept).collect()
    assert [(r.cId, r.cDpResult[0].sDpResult[0].cont) for r in found] == [(1, "a")]
    left = kept.table().filter("source = 'xml parses'").collect()
    assert sorted((r.key, r.reason) for r in left) == [("2", "broken"), ("3", "empty"), ("4", "empty")]
    # nothing is written where nothing is left out
    clean = Quarantine(spark)
    parses.sifted_task_parses(spark.createDataFrame(rows[:1], "status string, result string"), clean)
    assert clean.table().isEmpty()


def test_counter_goes_on_and_repeats_a_delivery(spark):
    path = new_folder(spark, "counter")
    counter = comments.Counter(spark, path)
    rows = spark.range(1000).repartition(5)
    ids = lambda df: sorted(r.cId for r in df.collect())
    assert ids(comments.counter_ids(rows, counter, "a")) == list(range(1000))
    assert ids(comments.counter_ids(rows.limit(0), counter, "none")) == []
    counter = comments.Counter(spark, path)
    second = comments.counter_ids(rows.limit(10), counter, "b")
    assert ids(second) == list(range(1000, 1010)) == ids(comments.counter_ids(rows.limit(10), counter, "b"))
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_partitions_replace_themselves(spark):
    path = new_folder(spark, "replaced")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "pId int, value string")
    for _ in range(2):
        tables.replace_partitions(rows, path, ["pId"])
    tables.replace_partitions(rows.filter("pId = 2").withColumn("value", F.lit("c")), path, ["pId"])
    found = tables.read_table(spark, path, schema=rows.schema).select("pId", "value").collect()
    assert sorted(map(tuple, found)) == [(1, "a"), (2, "c")]


def test_page_cache_keeps_the_newest(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("u1", "old", 200, day(1)), ("u2", "x", 200, day(2)), ("u1", "new", 503, day(3)), ("u1", "late", 200, day(2))]
    path = new_folder(spark, "cache")
    for part in (rows[:2], rows[2:], rows[2:], rows[:1]):
        web_pages.upsert_pages(spark, path, spark.createDataFrame(part, schemas.PAGE_CACHE), 4)
    schema = spark.createDataFrame(rows, schemas.PAGE_CACHE).withColumn("bucket", F.lit(0)).schema
    found = web_pages.read_pages(spark, path, schema).collect()
    assert sorted((r.url, r.html, r.code) for r in found) == [("u1", "new", 503), ("u2", "x", 200)]


def test_charset_setting_is_put_back(spark):
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key)
    pages = spark.createDataFrame([("好的 ok",)], "body string")
    raw = review_pages.encoded(pages, "body")
    assert spark.conf.get(key) == before
    assert raw.first().body == "好的 ok".encode("gbk")
    assert review_pages.decoded(raw, "body").first().body == "好的 ok" and spark.conf.get(key) == before


def test_references_are_resolved_once(spark):
    cases = {
        "&#38;lt;": "&lt;", "&amp;#65;": "&#65;", "&#x1F600;": "\U0001F600", "&#xD83D;&#xDE00;": "&#xD83D;&#xDE00;",
        "&#1114111;": chr(0x10FFFF), "&#1114112;": "&#1114112;", "&#99999999999999999999;": "&#99999999999999999999;",
        "&#x000041;": "A", "a&b;c": "a&b;c", "&&lt;": "&<", "&#;": "&#;", "": "", "&lt": "&lt",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "html string")
    found = rows.select("html", web_pages.text_content(F.col("html")).alias("text")).collect()
    assert {r.html: r.text for r in found} == cases


def test_tags_of_two_deliveries(spark):
    schema = (
        "pId bigint, cId bigint, feature struct<cont:string>, sentiment struct<cont:string>, "
        "neg_adv struct<cont:string>, deg_value int"
    )
    rng = random.Random(4)
    rows = [
        (rng.randint(1, 2), rng.choice([1, 2, 32768, 32769, 70000]), (rng.choice("ab"),), (rng.choice("xyz"),), None, rng.choice([-1, 1]))
        for _ in range(200)
    ]
    degrees = spark.createDataFrame(rows, schema)
    features = spark.createDataFrame([(1, "a", 5), (1, "b", 4), (2, "a", 4)], "pId bigint, name string, freq bigint")
    parts = [tags.tag_counts(spark.createDataFrame(part, schema)) for part in (rows[:70], rows[70:])]
    merged = tags.tags_of_counts(tags.merged_counts(*parts), features)
    whole = tags.feature_tags(degrees, features)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_counted_bayes(spark):
    training = spark.createDataFrame(
        [("a", ["good", "good", "film"], 1), ("b", ["bad", "film"], 0), ("c", [], 0)], "text string, tokens array<string>, label int"
    )
    model = classify.fit_bayes(training)
    weights = {r.word: (r.negative, r.positive) for r in model.weights.collect()}
    # three words; two of the negative class and three of the positive
    from math import isclose, log

    assert isclose(weights["good"][0], log(1 / 5)) and isclose(weights["good"][1], log(3 / 6))
    assert isclose(model.prior, log(1 / 2))
    new = spark.createDataFrame(
        [("p", ["good", "new"], 1), ("q", ["bad"], 0), ("r", ["new"], 0), ("s", [], 0)], "text string, tokens array<string>, label int"
    )
    found = {r.text: r.prediction for r in classify.bayes_predictions(model, new).collect()}
    assert found == {"p": 1, "q": 0, "r": 0, "s": 0}


def test_batches_of_a_stream_read_no_history(spark):
    inbox, out, progress = (new_folder(spark, n) for n in ("inbox", "out", "progress"))
    for i in range(12):
        # every id comes twice, two files apart
        made = [(f"r{k}", "SUCCESS", f'[{{"content":"text number{k}","score":5}}]', None) for k in (i, i + 2)]
        spark.createDataFrame(made, ingest.RESULTS).coalesce(1).write.mode("append").json(inbox)
    query = ingest.start_ingest(ingest.result_stream(spark, inbox, 1), out, progress)
    query.awaitTermination()
    done = [p for p in query.recentProgress if p.numInputRows]
    assert len(done) == 12 and {p.numInputRows for p in done} == {2}
    state = [p.stateOperators[0] for p in done]
    assert "rocksdbGetCount" in state[0].customMetrics
    # as many look-ups in the last batch as in the first, while the state grows
    gets = [s.customMetrics["rocksdbGetCount"] for s in state]
    assert max(gets) <= 4 * len(made) and state[-1].numRowsTotal == 14
    found = [r._id for r in spark.read.schema("_id string").parquet(out).collect()]
    assert sorted(found) == sorted(f"r{k}" for k in range(14))
