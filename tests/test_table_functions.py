"""Table functions called from SQL text against the operators on columns."""

import random

from pyspark.sql import functions as F

from brightloom.functions import tables
from brightloom.functions import text as T
from brightloom.operators import ranking


def test_slices_from_sql(spark):
    tables.register(spark)
    rng = random.Random(12)
    words = ["the", "die", "plain", "word", "long" * 8]
    files = [(f"f{i % 25}", "\n \n".join(" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9)))) for i in range(25)]
    texts = spark.createDataFrame([*files, ("empty", ""), ("none", None), ("long", ("die the " * 15 + "\n\n") * 3000)], "file string, text string")
    texts.createOrReplaceTempView("slice_texts")
    got = spark.sql("SELECT * FROM slices(TABLE(slice_texts) PARTITION BY (file), array('the', 'die')) ORDER BY score DESC, file, i, n LIMIT 30").collect()
    want = ranking.slices(texts, ["the", "die"]).select("file", "i", "n", "passage", "score").collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) and len(got) == 30


def test_slices_of_a_file_in_many_rows(spark):
    tables.register(spark)
    rows = [("a", "x " * 20 + f"{i:04d} " + "the " * (i * 7 % 11 + 8)) for i in range(3000)] + [(None, "the " * 30)]
    spark.createDataFrame(rows, "file string, text string").repartition(5).createOrReplaceTempView("slice_rows")
    got = spark.sql("SELECT file, score FROM slices(TABLE(slice_rows) PARTITION BY (file), array('the'))").collect()
    assert sorted(((r.file or "-"), r.score) for r in got) == [("-", 30), ("a", 18), ("a", 18), ("a", 18)]


def test_footnotes_from_sql(spark):
    tables.register(spark)
    texts = ["a[^1]\n[^1]: [条目 7] one \n[^2]: [条目 8]\n[^1]: [条目 9] again", "", None, "[^x]: none", "[^3]: [条目 1] it's \\ \"quoted\""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows.createOrReplaceTempView("note_texts")
    query = spark.sql("SELECT id, n.* FROM note_texts, LATERAL footnotes(text) AS n")
    want = rows.select("id", F.inline(T.footnote_defs(F.col("text")))).collect()
    assert sorted(map(tuple, query.collect())) == sorted(map(tuple, want)) and len(want) == 3
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sliced_query_by_sql(spark, data):
    from brightloom.plans.catalog import QUERIES

    got, want = QUERIES["text_slices_sql"](spark, data), QUERIES["text_slices"](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert list(map(tuple, got.select(*want.columns).collect())) == list(map(tuple, want.collect()))
