from pyspark.sql import functions as F

from helpers import clauses, word
from reviewlens import schemas
from reviewlens.operators import evaluate, lexicon, negation, scoring, summary, tags
from reviewlens.operators import pairs as word_pairs

WIDE = f"pId bigint, cId bigint, sId int, pairNo int, feature {schemas.WORD}, sentiment {schemas.WORD}, relate string"


def neg(spark, text, feature_id, sentiment_id, order="numeric"):
    clause = clauses(spark, text)
    opinion = spark.createDataFrame(
        [(1, 1, 0, 0, word("屏幕", "n", feature_id), word("好", "a", sentiment_id), "SBV")], WIDE
    )
    row = negation.with_clause_context(opinion, clause, id_order=order).first()
    return row.neg_adv and row.neg_adv.id


def test_negation_parity(spark):
    f, s = "0:屏幕/n/SBV/3 ", " 3:好/a/HED/-1"
    assert neg(spark, f + "1:不/d/ADV/3 2:很/d/ADV/3" + s, 0, 3) == 1
    assert neg(spark, f + "1:不/d/ADV/3 2:没/d/ADV/3" + s, 0, 3) is None
    assert neg(spark, "0:屏幕/n/SBV/4 1:不/d/ADV/4 2:没/d/ADV/4 3:不/d/ADV/4 4:好/a/HED/-1", 0, 4) == 3
    assert neg(spark, f + "1:不/d/ATT/3 2:很/d/ADV/3" + s, 0, 3) is None
    assert neg(spark, f + "1:不/d/ADV/2 2:很/d/ADV/3" + s, 0, 3) is None
    assert neg(spark, "0:好/a/ATT/2 1:不/d/ADV/0 2:屏幕/n/HED/-1", 2, 0) is None


def test_word_id_order(spark):
    text = " ".join(f"{i}:x/n/HED/-1" for i in range(9)) + " 9:不/d/ADV/10 10:好/a/HED/-1"
    assert neg(spark, text, 2, 10) == 9
    assert neg(spark, text, 2, 10, "lexical") is None


def kept_clauses(spark, openers, with_pairs=(0, 1, 2)):
    texts = [f"0:{o} 1:屏幕/n/SBV/2 2:好/a/HED/-1" for o in openers]
    df = word_pairs.opinion_candidates(
        clauses(spark, *texts), "屏幕", negation.NEGATION, negation.ADVERSATIVE
    ).filter(F.col("sId").isin(list(with_pairs)))
    return [r.sId for r in negation.after_last_adversative(df).orderBy("sId").collect()]


def test_adversative_reset(spark):
    plain, but, noun = "很/d/ADV/2", "但是/c/ADV/2", "但是/n/ADV/2"
    assert kept_clauses(spark, [plain, but, plain]) == [1, 2]
    assert kept_clauses(spark, [plain, noun, plain]) == [0, 1, 2]
    assert kept_clauses(spark, [plain, but, plain], (0, 2)) == [0, 2]
    assert kept_clauses(spark, [plain, but, but]) == [2]


def dictionary(spark):
    negative = spark.createDataFrame([("差",), ("大",), ("贵",), ("",)], "word string")
    positive = spark.createDataFrame([("好",), ("漂亮",), ("大",), ("贵",)], "word string")
    lines = spark.createDataFrame(
        [("Aa01= zzz 差 好",), ("Aa02= qqq 好 差",), ("Ab01# rrr 差",), ("Aa03= qqq 差",)], "value string"
    )
    return scoring.word_polarity(lexicon.lexicon(negative, positive), lexicon.synonym_table(lines))


def test_polarity(spark):
    found = {r.word: r.polarity for r in dictionary(spark).collect()}
    assert found == {"好": 1, "漂亮": 1, "差": -1, "大": -1, "贵": -1, "zzz": -1, "qqq": 1}


def test_scores(spark):
    no = word("不", "d")
    rows = [
        (1, 1, 0, 0, word("屏幕"), word("好"), "SBV", None),
        (1, 1, 0, 1, word("屏幕"), word("好"), "SBV", no),
        (1, 1, 1, 0, word("屏幕"), word("生词"), "SBV", None),
        (1, 2, 0, 0, word("屏幕"), word("好"), "SBV", None),
        (1, 2, 0, 1, word("屏幕"), word("好"), "SBV", None),
        (1, 2, 0, 2, word("屏幕"), word("生词"), "SBV", None),
        (1, 3, 0, 0, word("屏幕"), word("差"), "SBV", no),
    ]
    df = spark.createDataFrame(rows, WIDE + f", neg_adv {schemas.WORD}")
    scored = scoring.score_tuples(df, dictionary(spark))
    values = [r.deg_value for r in scored.orderBy("cId", "sId", "pairNo").collect()]
    assert values == [1, -1, 0, 1, 1, 0, 1]
    degrees = {r.cId: r.cDegValue for r in scoring.comment_degrees(scored).collect()}
    assert degrees == {1: 0.0, 2: 2 / 3, 3: 1.0}
    nested = scoring.nest_degrees(scored)
    assert {r.cId: r.cDegValue for r in nested.collect()} == degrees
    assert [r.deg_value for r in scoring.flat_degrees(nested).orderBy("cId", "sId").collect()] == values
    assert scoring.polar(scored).count() == 5


def degree_rows(spark, rows):
    return spark.createDataFrame(
        [(1, c, (f,), (s[-1:] if s.startswith("不") else s,), ("不" if s.startswith("不") else None,), v) for c, f, s, v in rows],
        "pId bigint, cId bigint, feature struct<cont:string>, sentiment struct<cont:string>, "
        "neg_adv struct<cont:string>, deg_value int",
    )


def vocabulary(spark, **freq):
    return spark.createDataFrame([(1, k, v) for k, v in freq.items()], schemas.VOCABULARY)


def test_feature_tag(spark):
    df = degree_rows(
        spark, [(1, "屏幕", "好", 1), (2, "屏幕", "好", 1), (2, "屏幕", "流畅", 1), (3, "屏幕", "不好", -1), (4, "电池", "好", 1)]
    )
    features = vocabulary(spark, 屏幕=9)
    row = tags.feature_tags(df, features).collect()
    assert len(row) == 1
    assert row[0].asDict() == {
        "pId": 1, "tFeature": "屏幕", "tSentiment": "好", "tRate": 0.75, "tIsPos": True,
        "tCount": 4, "tCommentCount": 3, "freq": 9,
    }
    sides = {(r.tIsGood, r.cId) for r in tags.tag_comments(df, features).collect()}
    assert sides == {(True, 1), (True, 2), (False, 3)}


def test_half_good_is_positive_and_ties_go_by_word(spark):
    df = degree_rows(spark, [(1, "屏幕", "b", 1), (1, "屏幕", "a", 1), (1, "屏幕", "c", -1), (2, "屏幕", "d", -1)])
    row = tags.feature_tags(df, vocabulary(spark, 屏幕=1)).first()
    assert (row.tRate, row.tIsPos, row.tSentiment) == (0.5, True, "a")


def tag_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "pId bigint, tFeature string, tSentiment string, tRate double, tIsPos boolean, tCount bigint, "
        "tCommentCount bigint, freq bigint",
    )


def test_hot_tags(spark):
    df = tag_frame(
        spark,
        [(1, "a", "x", 1.0, True, 2, 1, 9), (1, "b", "x", 0.9, True, 3, 1, 9), (1, "c", "x", 0.6, True, 7, 1, 9)],
    )
    hot = tags.hot_tags(df)
    assert [(r.tFeature, r["rank"]) for r in hot.collect()] == [("c", 1)]
    many = tag_frame(
        spark,
        [(1, f"f{i:03}", "x", 0.9 - i / 1000, False, 10, 1, 5) for i in range(150)]
        + [(1, "rare", "x", 1.0, False, 1, 1, 5)],
    )
    assert [r.tFeature for r in tags.hot_tags(many).orderBy("rank").collect()] == [f"f{i:03}" for i in range(100)]


def test_summary_keeps_products_without_hot_tags(spark):
    degrees = spark.createDataFrame(
        [(1, 1, 0.6), (1, 2, 0.5), (2, 3, -1.0)], "pId bigint, cId bigint, cDegValue double"
    )
    hot = tags.hot_tags(
        tag_frame(spark, [(1, "a", "x", 1.0, True, 2, 1, 9), (1, "b", "x", 0.9, True, 3, 1, 9)])
    )
    rows = {
        r.pId: r for r in summary.product_summary(summary.product_totals(degrees), hot).collect()
    }
    assert [t.tFeature for t in rows[1].hotPosTagStatistics] == ["b"]
    assert rows[2].hotPosTagStatistics == [] and rows[2].hotNegTagStatistics == []
    assert rows[1].productCommentSummary.asDict() == {"identifiedCount": 2, "goodCount": 1, "goodRate": 0.5}


def test_quality(spark):
    degrees = spark.createDataFrame(
        [(1, 1, 0.6), (1, 2, 0.5), (1, 3, 1.0), (1, 4, -1.0)], "pId bigint, cId bigint, cDegValue double"
    )
    comments = spark.createDataFrame(
        [(1, 1, "", 5), (1, 2, "", 4), (1, 3, "", 2), (1, 4, "", 1), (1, 9, "", 5)], schemas.COMMENTS
    )
    row = evaluate.classification_quality(degrees, comments).first()
    assert (row.tp, row.predicted_true, row.actual_true, row.all_count) == (1, 2, 2, 4)
    assert (row.p, row.r, row.f) == (0.5, 0.5, 0.5)
    none = evaluate.classification_quality(degrees.filter("cId = 4"), comments).first()
    assert none.p is None and none.f is None
