"""Decontamination of texts that repeat the benchmark's words."""

import random
import time

import duckdb
from conftest import same_rows

from tessera.llm.decontaminate import OP2_SQL, decontaminate, op2_decontaminate


def test_a_word_a_million_times_takes_seconds(spark):
    docs = spark.createDataFrame([(1, "a " * 1_000_000), (2, "b " + "a " * 9), (3, "a " * 1_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a " * 10), ("y", "a " * 11 + "b")], "item_id string, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert time.time() - began < 60
    assert [tuple(map(tuple, got[i].spans)) for i in (1, 2, 3)] == [((0, 1_000_000),), (), ((0, 1_000_000),)] and got[1]["items"] == ["x", "y"]


def test_few_words_match_the_sql(spark, tmp_path):
    """Texts and items over three words: most places are candidates of most windows."""
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choices("abc", [6, 2, 1], k=n))
    docs = [(i, line(rng.choice([5, 60, 200]))) for i in range(30)] + [(30, "a " * 500), (31, None), (32, "a " * 500)]
    docs += [(40 + i, docs[0][1]) for i in range(20)]
    items = [(str(i), line(rng.choice([3, 10, 12]))) for i in range(12)] + [("all", "a " * 10), ("all", "a " * 10)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    same_rows(op2_decontaminate(spark, str(tmp_path)).toPandas(), con.sql(OP2_SQL).df())
