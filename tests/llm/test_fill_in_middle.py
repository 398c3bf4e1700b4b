"""Fill-in-the-middle against a plain rendering of its rules."""

import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm.fill_in_middle import fill_in_middle, op11_fill_in_middle

DOCS = "doc_id long, text string, rest string, n long"


def _plain(doc_id, text, cut=90, first=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return n, "plain", None, None, text, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < first else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < first else "psm", len(p), len(m), out, text


TEXTS = [None, "", "a", "one two  three", "<P>", "x <S> y", "<<P", "<S", "é🤦🏼‍♂️ naïve\r\n\ttext\x00end", "<M <P <S " * 5, "ABC" * 1000 + "\n" + "12 " * 500, "word " * 60_000]


def _table(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS * 8)] + [(3, TEXTS[3], None, None), (3, TEXTS[3], None, None), (None, "no id here", "c", 1), (-5, "less than none", None, 2)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_outputs_are_the_rules(spark):
    rows, docs = _table(spark)
    for cut, first in ((90, 20), (100, 0), (100, 100), (0, 50)):
        got = fill_in_middle(docs, cut, first).select("rest.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *_plain(r[0], r[1], cut, first))) for r in rows)


def test_other_columns_stay(spark):
    docs = _table(spark)[1]
    got = fill_in_middle(docs).select("rest.*", F.col("n").alias("tokens"))
    assert got.columns == ["doc_id", "rest", "n", "tokens"]
    assert got.where("rest = 'clash' AND n = 1").count() == 1


def test_no_rows_and_small_batches(spark, tmp_path):
    rows, docs = _table(spark)
    assert fill_in_middle(docs.limit(0)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = op11_fill_in_middle(spark, str(tmp_path)).select("doc_id", "restored_sha256").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in rows)


def test_forms_have_their_shares(spark):
    form = fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 4000 for r in form}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.02 and abs(share["psm"] - 0.72) < 0.03
