"""Line deduplication with sharded minimal perfect hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import bound_batches, discard, materialize
from tessera.llm.tokens import mix

#: Code points that a key needs to be looked up.
MIN_KEY = 10
#: Distinct lines of a shard, and rows that probe one copy of a shard, about.
SHARD_KEYS, PROBES = 1 << 18, 1 << 18
#: Bits of a level of the perfect hash per key left.
GAMMA = 2.0
#: Names of rows without an id are numbers from here, of their texts; ids are below.
NO_ID = 1 << 62


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to be looked up."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()  # of bytes: A-Z only
    if len(key) < MIN_KEY or len(key) < 4 * MIN_KEY and sum(b & 0xC0 != 0x80 for b in key) < MIN_KEY:
        return None
    return key


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Minimal perfect hash of distinct (a, b) pairs: at each level, keys alone in their slot stay and others go on."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = []
        total = 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(a + mix(b + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(64, int(GAMMA * len(a)))
            at = cls.slot(a, b, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(levels)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some that aren't known, while others get any index."""
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self.slot(a[open_], b[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in packed])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc) of each document's distinct keys."""
    for batch in batches:
        held, docs = [], []
        ids = batch.column("doc").to_pylist()
        for doc, text in zip(ids, batch.column("text")):
            if not text.is_valid:
                continue
            own = {_hash(k) for k in map(line_key, bytes(text.as_buffer()).split(b"\n")) if k is not None}
            held += own
            docs += [doc] * len(own)
        flat = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2) if held else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1])), pa.array(docs, pa.int64())], names=["a", "b", "doc"])


SHARDS = "shard int, n long, uses long, levels array<binary>, fingerprints binary, counts binary, owners binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """One shard: the perfect hash of its keys and, by its index, fingerprint, count and owner of each."""
    a, b = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in "ab")
    built = PerfectHash.build(a, b)
    at = built.index(a, b)
    out = {"fingerprints": b, "counts": table.column("count").to_numpy().astype(np.uint64), "owners": table.column("owner").to_numpy()}
    placed = {}
    for name, values in out.items():
        placed[name] = np.empty_like(values)
        placed[name][at] = values
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(a)], pa.int64()), "uses": pa.array([int(table.column("uses").to_numpy().sum())], pa.int64()),
        "levels": pa.array([built.pack()], pa.list_(pa.binary())), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in placed.items()},
    })


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, a) of lines that two documents or more have and another one owns. Rows come by (shard, salt), each shard's arrays first."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        salt = batch.column("salt").to_numpy()
        arrays = batch.column("levels").is_valid().to_numpy(zero_copy_only=False)
        a, b = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in "ab")
        doc = batch.column("doc").fill_null(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1, [len(shard)]])
        docs, keys = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if arrays[lo]:
                row = {c: batch.column(c)[int(lo)].as_py() for c in ("levels", "fingerprints", "counts", "owners")}
                held = PerfectHash.unpack(row["levels"]), np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.uint64), np.frombuffer(row["owners"], np.int64)
                lo += 1
            if lo == hi:
                continue
            s = slice(lo, hi)
            at = held[0].index(a[s], b[s])
            lose = (at >= 0) & (held[1][at] == b[s]) & (held[2][at] >= 2) & (held[3][at] != doc[s])
            docs.append(doc[s][lose])
            keys.append(a[s][lose].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs) if docs else [], pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["doc", "a"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines lost."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        lost = batch.column("lost")
        for i, text in enumerate(batch.column("text")):
            raw = bytes(text.as_buffer()) if text.is_valid else b""
            parts = raw.split(b"\n")
            lines.append(len(parts))
            if lost[i].is_valid:
                gone = set(lost[i].values.to_pylist())
                kept = [x for x in parts if (k := line_key(x)) is None or int.from_bytes(_hash(k)[:8], "little", signed=True) not in gone]
                dropped.append(len(parts) - len(kept))
                raw = b"\n".join(kept)
            else:
                dropped.append(0)
            texts.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["rest", "text", "n_lines", "n_dropped"]
        )


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """Documents without the lines that another document has already.

    A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. Keys of MIN_KEY code points or more
    found in at least two documents lose all their lines except in the smallest id holding them.

    Keys are 128-bit hashes. Distinct keys are counted with a map-side combine and dealt into shards of about shard_keys by
    the hash; each shard becomes a minimal perfect hash with arrays of fingerprints (64 more bits of the hash), counts of
    documents and owners. Every document's keys then probe the arrays of their shard; a shard with many
    probes, as one of a line that a third of all documents hold, is copied so that a copy gets about `probes`, and
    rows stream past the arrays, so no group is held in memory. What a document loses goes back to it by id.

    Returns one row per input row: rest (struct of the other input columns, of whatever names), text (kept lines joined by
    newlines), n_lines (before), n_dropped. Null and empty texts have one empty line. Ids are integers below 2 ** 62. Rows of
    one id are one document; rows without an id come last and are documents of their own, but for those of equal texts, which are
    one. An empty table gives no rows. What one document loses fits one row (2 GB). Lowers the session's limits on Arrow batches (bound_batches).
    """
    spark = documents.sparkSession
    bound_batches(spark)
    doc = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))
    lines = materialize(documents.select(doc.alias("doc"), F.col(text_col).alias("text")).mapInArrow(_hash_lines, "a long, b long, doc long"), "lines")
    total = lines.count()
    n_shards = max(1, -(-total // shard_keys))
    shard = F.pmod("b", F.lit(n_shards)).cast("int")
    counted = lines.groupBy("a", "b").agg(F.count("*").alias("uses"), F.min("doc").alias("owner"), F.max("doc").alias("last"))
    # rows of one id are one document
    counted = counted.select("a", "b", "uses", "owner", F.when(F.col("owner") == F.col("last"), 1).otherwise(F.col("uses")).alias("count"), shard.alias("shard"))
    shards = materialize(counted.groupBy("shard").applyInArrow(_build, SHARDS), "line-shards")
    # of shards with more probes than one copy takes, the number of copies; Spark sees how small this table is
    copies = materialize(shards.where(F.col("uses") >= probes).select("shard", (F.floor(F.col("uses") / probes) + 1).cast("int").alias("copies")), "line-copies")
    times = F.coalesce("copies", F.lit(1))
    arrays = ("fingerprints", "counts", "owners")
    copied = shards.join(copies, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), times - 1)).alias("salt"), "levels", *arrays, *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "doc")])
    asked = lines.withColumn("shard", shard).join(copies, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("doc"), times).cast("int").alias("salt"), F.lit(None).cast("array<binary>").alias("levels"), *[F.lit(None).cast("binary").alias(c) for c in arrays], "a", "b", "doc"
    )
    met = copied.unionAll(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("levels").isNull())
    lost = materialize(met.mapInArrow(_probe, "doc long, a long").groupBy("doc").agg(F.collect_set("a").alias("lost")), "lost-lines")
    discard(lines, shards, copies)
    rows = documents.select(doc.alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"))
    joined = rows.join(lost, rows.key == lost.doc, "left").select("rest", "text", "lost")
    return joined.mapInArrow(_apply, f"rest {joined.schema['rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("rest.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_ctes(docs: str) -> str:
    return f"""
cut AS (SELECT doc_id, i, lines[i] AS line, trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}))),
owned AS (SELECT key, min(doc_id) AS owner FROM cut WHERE length(key) >= {MIN_KEY} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '') AS text FROM cut LEFT JOIN owned USING (key) GROUP BY doc_id)"""


OP3_SQL = f"WITH {op3_ctes('documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"
