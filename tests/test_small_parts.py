"""Column functions answer in parts of bounded size, with the same rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from reviewlens.functions import clause_places, plain_xml, small_parts
from reviewlens.plans import derived_words
from reviewlens.plans import driver_tables as tables


def test_parts_are_bounded_and_in_order():
    texts = pa.array(["x" * (k % 50) if k % 7 else None for k in range(400)] + ["y" * 5_000, "z"])
    numbers = pa.array(range(len(texts)))
    found = list(small_parts.parts([texts, numbers], 1_000))
    assert [v for part in found for v in part[0].to_pylist()] == texts.to_pylist()
    assert [v for part in found for v in part[1].to_pylist()] == numbers.to_pylist()
    assert all(len(part[0]) == 1 or sum(x.nbytes for x in part) <= 1_000 for part in found)
    lists = pa.array([["ab"] * (k % 9) for k in range(300)])
    found = list(small_parts.parts([lists.slice(10)], 500))
    assert [v for part in found for v in part[0].to_pylist()] == lists.to_pylist()[10:] and len(found) > 20
    assert [len(part[0]) for part in small_parts.parts([texts.slice(0, 0)], 1)] == [0]


def _answers_in_parts(df, column):
    df.select(column.alias("found")).write.format("noop").mode("overwrite").save()
    plan = df.select(column.alias("found"))._jdf.queryExecution().executedPlan().toString()
    return "of_one(" in plan or "of_many(" in plan


def test_a_worker_answers_part_by_part(spark):
    rows = spark.range(500, numPartitions=1).select("id", F.repeat(F.lit("a"), F.lit(100)).alias("text"))

    def in_part(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    def shorter(texts: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([f"{i}-{len(texts)}" for i in ids.to_pylist()])

    sizes = rows.select(small_parts.in_parts(in_part, "int", 2_000, F.col("text")).alias("n")).collect()
    assert len(sizes) == 500 and max(r.n for r in sizes) <= 20
    both = rows.select("id", small_parts.in_parts(shorter, "string", 2_000, F.col("text"), F.col("id")).alias("x")).collect()
    assert [r.x.split("-")[0] for r in both] == [str(r.id) for r in both]
    assert max(int(r.x.split("-")[1]) for r in both) <= 20


def test_words_pairs_and_xml_are_made_in_parts(spark, sf_dir, monkeypatch):
    def field(name):
        return lambda words: words.getField(name)

    def results():
        parsed, xml = tables.comments_dp(spark, sf_dir), tables.comments_xml(spark, sf_dir)
        one = parsed.limit(50)
        words = F.transform("cDpResult", lambda s: s["sDpResult"])
        links = [F.transform(words, field(name)) for name in ("id", "parent", "relate")]
        flat = [F.flatten(x) for x in links]
        columns = [
            (one, derived_words.parse_xml(F.col("cDpResult"))),
            (one, clause_places.comment_places(*links)),
            (one, clause_places.clause_places(*flat)),
            (xml.limit(50), plain_xml.clauses_of_plain(F.col("xml"))),
        ]
        assert all(_answers_in_parts(df, column) for df, column in columns)
        assert "of_one(" in parsed._jdf.queryExecution().executedPlan().toString()
        back = xml.select("pId", "cId", plain_xml.clauses_of_plain(F.col("xml")).alias("cDpResult"))
        made = parsed.select("cId", derived_words.parse_xml(F.col("cDpResult")).alias("xml"))
        assert made.exceptAll(xml.select("cId", "xml")).isEmpty() and xml.count() == made.count()
        places = parsed.select("cId", clause_places.comment_places(*links).alias("p"))
        return [sorted(map(repr, df.orderBy("cId").collect())) for df in (parsed, xml, back, places)]

    whole = results()
    for module, name in ((derived_words, "TEXT_AT_ONCE"), (derived_words, "WORDS_AT_ONCE"), (plain_xml, "BYTES_AT_ONCE"), (clause_places, "BYTES_AT_ONCE")):
        monkeypatch.setattr(module, name, 5_000)
    assert results() == whole
