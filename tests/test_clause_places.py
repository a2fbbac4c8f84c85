import random

import pyarrow as pa

from helpers import clauses
from reviewlens import schemas
from reviewlens.functions import clause_places
from reviewlens.operators import pairs as word_pairs

RELATIONS = ["SBV", "VOB", "ATT", "CMP", "COO", "COO", "ADV", None]


def one_by_one(ids, parents, relates):
    """The pairs of a clause by looking at every other word."""
    out = []
    for i, (own, above, relate) in enumerate(zip(ids, parents, relates)):
        if relate not in ("SBV", "VOB", "ATT", "CMP"):
            continue

        def beside(key):
            return [m for m, r in enumerate(relates) if r == "COO" and key is not None and parents[m] == key]

        head = ids.index(above) if above is not None and above in ids else None
        of_w, of_h = beside(own), beside(above)
        found = [(0, i, head)]
        for m in sorted({*of_w, *of_h}):
            found += [(1, m, head)] * (m in of_w) + [(2, i, m)] * (m in of_h)
        if of_w and of_h:
            found.append((3, of_w[-1], of_h[-1]))
        for kind, dependent, governor in found:
            if governor is not None:
                sides = (dependent, governor) if relate in ("ATT", "SBV") else (governor, dependent)
                out.append({"word": i, "kind": kind, "first": sides[0], "second": sides[1]})
    return out


def test_odd_clauses_in_several_goes(monkeypatch):
    rng = random.Random(5)
    made = [None, ([], [], [])]
    for size in [1, 2, 3, 8, 30, 3, 90, 1, 5] * 4:
        values = [*range(size), None, -1]
        made.append(tuple([rng.choice(of) for _ in range(size)] for of in (values, values, RELATIONS)))
    columns = [pa.array([None if x is None else x[k] for x in made], pa.list_(kind))
               for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
    expected = [None if x is None else one_by_one(*x) for x in made]
    for most in (1, 40, 1_000_000):
        monkeypatch.setattr(clause_places, "WORDS_AT_ONCE", most)
        assert clause_places.place_lists(*columns).to_pylist() == expected
        assert clause_places.place_lists(*[x.slice(3) for x in columns]).to_pylist() == expected[3:]


def test_null_words_and_clauses(spark):
    word = (0, "a", "n", "O", 1, "SBV")
    rows = [(1, 1, None), (1, 2, [None, (0, None), (1, [word, None, (1, "b", "a", "O", -1, "HED")])]), (1, 3, [])]
    nested = word_pairs.comment_pairs(spark.createDataFrame(rows, schemas.COMMENTS_DP)).collect()
    found = {r.cId: r.cDpPairs for r in nested}
    assert found[1] is None and found[3] == []
    assert [(s.sId, s.sDpPairs and len(s.sDpPairs)) for s in found[2]] == [(None, None), (0, None), (1, 1)]
    assert [(p.first.cont, p.second.cont) for p in found[2][2].sDpPairs] == [("a", "b")]


def test_places_take_no_lambda_for_each_word(spark):
    plan = word_pairs.dependency_pairs(clauses(spark, "0:a/n/SBV/1 1:b/a/HED/-1"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_heads_of_the_derived_words(spark):
    from pyspark.sql import functions as F

    from reviewlens.plans import driver_tables as tables

    parsed = tables._parsed(F.lit(" ".join(["w"] * 60)))
    words = spark.range(1).select(F.inline(parsed)).collect()
    steps = {4: -2, 10: -4, 16: -8, 22: -16}
    for w in words:
        kind = w.id % 6
        expected = -1 if kind == 2 else w.id + (steps[w.id % 24] if kind == 4 else {0: 2, 1: 1, 3: -1, 5: -3}[kind])
        assert (w.parent, w.relate) == (expected, tables.RELATIONS[kind])
    assert "CASE" not in spark.range(1).select(parsed)._jdf.queryExecution().analyzed().toString()
