"""Fill-in-the-middle transformation, as DuckDB SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import bound_batches
from tessera.llm.tokens import slices

#: Marks of prefix, suffix and middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are cut, and of the cut ones that put the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Begins the hashed name of a document; another one gives other cuts.
SEED = "1:"
#: Tokens are runs of ASCII letters and single other code points.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that are tokenised at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20

_SQL = f"""
WITH named AS (
  SELECT row, text, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256('{SEED}' || coalesce(id::VARCHAR, '')) AS h FROM batch
), drawn AS (
  SELECT row, text, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM named
), cut AS (
  SELECT row, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= $cut THEN 'plain' WHEN h4 % 100 < $first THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT row, text, n, form, array_to_string(list_slice(tokens, 1, a), '') AS prefix, array_to_string(list_slice(tokens, a + 1, b), '') AS middle, array_to_string(list_slice(tokens, b + 1, n), '') AS suffix FROM cut
), joined AS (
  SELECT row, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
  FROM parts
), split AS (
  SELECT *, CASE WHEN form = 'psm' THEN strpos(output, '{SUFFIX}') ELSE strpos(output, '{PREFIX}') END AS second, strpos(output, '{MIDDLE}') AS third FROM joined
)
SELECT row, n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, output,
  CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN output[{len(PREFIX) + 1}:second - 1] || output[third + {len(MIDDLE)}:] || output[second + {len(SUFFIX)}:third - 1]
    ELSE output[second + {len(PREFIX)}:third - 1] || output[third + {len(MIDDLE)}:] || output[{len(SUFFIX) + 1}:second - 1] END AS restored
FROM split ORDER BY row
"""

_COLUMNS = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("restored", T.StringType())]
)


def fill_in_middle(docs: DataFrame, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text, and any others): rest (its columns but text), n, form, prefix_chars, middle_chars, output, restored.

    A text's n tokens are cut at two places drawn from the SHA-256 of its doc_id, so reruns and repeated rows agree; output
    holds the parts with their marks, prefix first (psm) or suffix first (spm), and restored is the text read back from output
    and form alone. Texts that hold a mark are left plain, as are empty and null texts (null counts as empty), so a mark in an
    output is always ours. A row without an id is drawn as one whose number is empty. A text of any length is one row; without
    rows there are none.
    """
    bound_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    source = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        con.execute("SET preserve_insertion_order = false")
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES):
                rows = batch.slice(part.first, part.last - part.first)
                con.register("batch", pa.table({"row": pa.array(range(rows.num_rows), pa.int64()), "id": rows.column("id"), "text": rows.column("text")}))
                done = con.sql(_SQL, params={"cut": cut_percent, "first": suffix_first_percent}).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [rows.column("rest"), *(done.column(f.name).combine_chunks() for f in _COLUMNS)]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["rest", *_COLUMNS.names])

    return source.mapInArrow(transform, T.StructType([source.schema["rest"], *_COLUMNS]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and digests of every document's output and of the text restored from it."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("rest.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Tokens numbered one by one, parts by their sums of lengths.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hashed AS (SELECT *, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]')) AS n FROM docs),
drawn AS (SELECT row, doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS u, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS v FROM hashed),
tokens AS (SELECT row, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]')) AS token, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), 1) AS k FROM docs),
sizes AS (SELECT row, sum(CASE WHEN k <= least(x, y) THEN length(token) ELSE 0 END)::BIGINT AS p, sum(CASE WHEN k > least(x, y) AND k <= greatest(x, y) THEN length(token) ELSE 0 END)::BIGINT AS m FROM tokens JOIN drawn USING (row) GROUP BY row),
cut AS (SELECT doc_id, text, n, coalesce(p, 0) AS p, coalesce(m, 0) AS m, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn LEFT JOIN sizes USING (row)),
parts AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
