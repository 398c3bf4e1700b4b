"""Exact deduplication by deterministic block naming (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize

#: Bytes of a block.
BLOCK_BYTES = 4096


def _names(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Name each row (doc, sha, at, *keys) by the sorted first holder of equal keys.

    Equal keys are grouped after a map-side combine, so a block that a third of all rows share reaches the shuffle once
    per task; the join back is one that AQE can split. A name is the integer pair (doc, at) of the least holder, which a
    repeated task computes again as the same one, and which two different contents never share; a number of its text tells
    holders of one id, or of none, apart.
    """
    holder = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("sha").alias("text"), "at")
    first = blocks.groupBy(*keys).agg(F.min(holder).alias("first"))
    return (
        blocks.join(first, [blocks[k].eqNullSafe(first[k]) for k in keys])
        .select("doc", "sha", "at", F.col("first").alias("name"))
    )


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of documents whose texts are identical without white space `[\\x20\\x09-\\x0D]`.

    The normalised text is cut into blocks of block_bytes. Equal blocks get one integer name; adjacent names are paired
    and named again, until each document has a single name. Documents are equal if and only if they have as many bytes
    and the same name: names come from comparing contents, never from a hash.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256, n_code_points, identity.
    Null text counts as empty, and all empty texts are one group. Of equal texts the row with the most code points in the
    original text stays, then the smallest id; a null id counts as the largest, and a group of such rows alone keeps null. Repeated
    rows each count in group_size, and all rows with the id that stays are marked kept. Ids are integers. An empty table gives no
    rows. Other columns of the input are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc"), F.length(text).cast("long").alias("points"), bare.alias("bare")
    ).select("doc", "points", "bare", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"))
    rows = docs.select("doc", "points", "text_sha256", F.octet_length("bare").cast("long").alias("bytes"))
    cut = F.expr(f"transform(sequence(0, greatest(cast((octet_length(raw) - 1) div {block_bytes} as int), 0)), i -> substring(raw, i * {block_bytes} + 1, {block_bytes}))")
    blocks = (
        docs.select("doc", F.unhex("text_sha256").alias("sha"), F.col("bare").cast("binary").alias("raw"))
        .select("doc", "sha", F.posexplode(cut).alias("at", "block"))
        .withColumn("at", F.col("at").cast("long"))
    )
    stored = materialize(_names(blocks, ["block"]), "blocks")
    named, done = stored.distinct(), None
    while True:
        sized = named.groupBy("doc", "sha").agg(F.max("at").alias("last"), F.max("name").alias("name"))
        if done is None:
            tops = named.agg(F.max("at").alias("top"))
            top = (tops.first() or [0])[0] or 0
        if not top:
            break
        # pairs of adjacent names; an odd last name is paired with null
        pairs = named.groupBy("doc", "sha", F.expr("at div 2").alias("pair")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b")
        ).withColumnRenamed("pair", "at")
        before, stored = stored, materialize(_names(pairs, ["a", "b"]), "names")
        discard(before)
        named = done = stored
        top //= 2
    # one name each; documents of unequal block counts differ in bytes
    identity = sized.select("doc", F.lower(F.hex("sha")).alias("text_sha256"), "name")
    rows = rows.join(identity, [rows.doc.eqNullSafe(identity.doc), rows.text_sha256 == identity.text_sha256]).select(rows.doc, "points", rows.text_sha256, "bytes", "name")
    groups = rows.groupBy("bytes", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("points", F.expr("~doc").alias("order"), F.lit(1).alias("one"))).alias("best"), F.max("points").alias("most"))
    return (
        rows.join(groups, ["bytes", "name"])
        .withColumn("keep_id", F.expr("~best.order"))
        .select(
            F.col("doc").alias(id_col), "keep_id", "group_size",
            (F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
            "text_sha256", F.col("points").alias("n_code_points"), F.struct("bytes", "name").alias("identity"),
        )
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("identity", "n_code_points")


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), groups AS (
  SELECT bare, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM docs GROUP BY bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM docs JOIN groups USING (bare)
"""
