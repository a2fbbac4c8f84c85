import duckdb
import pandas as pd

from helpers import clauses, words
from reviewlens import schemas
from reviewlens.operators import pairs as word_pairs
from reviewlens.plans.oracle import _PARTS


def found(df):
    rows = word_pairs.with_sides(word_pairs.dependency_pairs(df)).orderBy("cId", "sId", "pairNo")
    return [(r.feature.cont, r.sentiment.cont, r.kind, r.relate) for r in rows.collect()]


P1 = "0:屏幕/n/SBV/2 1:外观/n/COO/0 2:好/a/HED/-1 3:大/a/COO/2"


def test_coordination(spark):
    assert found(clauses(spark, P1)) == [
        ("屏幕", "好", "base", "SBV"),
        ("外观", "好", "dependent", "SBV"),
        ("屏幕", "大", "head", "SBV"),
        ("外观", "大", "cross", "SBV"),
    ]


def test_orientation(spark):
    assert found(clauses(spark, "0:好/a/ATT/1 1:屏幕/n/HED/-1")) == [("屏幕", "好", "base", "ATT")]
    df = clauses(spark, "0:喜欢/v/HED/-1 1:屏幕/n/VOB/0")
    row = word_pairs.dependency_pairs(df).first()
    assert (row.first.cont, row.second.cont) == ("喜欢", "屏幕")
    assert found(df) == [("喜欢", "屏幕", "base", "VOB")]


def test_clause_without_pairs_stays_in_nested_form(spark):
    df = spark.createDataFrame([(1, 1, [(0, words("0:好/a/HED/-1")), (1, words(P1))])], schemas.COMMENTS_DP)
    row = word_pairs.comment_pairs(df).first()
    assert [(s.sId, len(s.sDpPairs)) for s in row.cDpPairs] == [(0, 0), (1, 4)]
    assert word_pairs.flat_pairs(word_pairs.comment_pairs(df)).count() == 4


def test_cross_pair_takes_the_last_of_each_side(spark):
    assert [x[:3] for x in found(clauses(spark, P1 + " 4:手感/n/COO/0"))] == [
        ("屏幕", "好", "base"),
        ("外观", "好", "dependent"),
        ("屏幕", "大", "head"),
        ("手感", "好", "dependent"),
        ("手感", "大", "cross"),
    ]


def test_missing_head_gives_no_base_pair(spark):
    assert found(clauses(spark, "0:好/a/ATT/7")) == []
    # a word coordinated to the missing head still pairs with the dependent
    assert found(clauses(spark, "0:好/a/ATT/7 1:屏幕/n/COO/7")) == [("屏幕", "好", "head", "ATT")]


def by_sql(made):
    """The pairs of the clauses by the SQL that the queries are compared with."""
    words = pd.DataFrame(
        [(1, c, 0, i, cont, pos, relate, parent) for c, ws in enumerate(made) for i, cont, pos, _, parent, relate in ws],
        columns=["pid", "cid", "sid", "id", "cont", "pos", "relate", "parent"],
    )
    db = duckdb.connect()
    db.register("words", words)
    parts = ["q", "coo", "dependent_side", "head_side", "found", "pairs"]
    sql = f"""WITH {", ".join(_PARTS[p] for p in parts)}
        SELECT cid, relate, dep_id, head_id FROM pairs ORDER BY cid, pno"""
    out = {}
    for c, relate, dependent, head in db.execute(sql).fetchall():
        out.setdefault(c, []).append((dependent, head) if relate in ("ATT", "SBV") else (head, dependent))
    return out


def test_random_clauses_agree_with_sql(spark):
    import random

    rng = random.Random(7)
    made = []
    for size in [1, 2, 5, 9, 17, 40, 400, 700]:
        for _ in range(3):
            ids = list(range(size))
            made.append(
                [
                    (i, f"w{i}", "n", "O", rng.choice(ids + [-1]), rng.choice(["SBV", "VOB", "ATT", "CMP", "COO", "COO", "ADV"]))
                    for i in ids
                ]
            )
    df = spark.createDataFrame([(1, c, 0, ws) for c, ws in enumerate(made)], schemas.CLAUSES)
    rows = word_pairs.dependency_pairs(df).orderBy("cId", "pairNo").collect()
    mine = {}
    for r in rows:
        mine.setdefault(r.cId, []).append((r.first.id, r.second.id))
    assert mine == by_sql(made)


def test_pairs_plan_has_no_shuffle(spark):
    df = word_pairs.dependency_pairs(clauses(spark, P1))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
