"""Removal of byte strings that occur more than once, by suffix arrays of candidate segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import bound_batches, discard, materialize
from tessera.llm.tokens import Slice, mix, slices, span_hash

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of an anchor. Each window of LENGTH bytes has one, its least-hashed string of so many bytes.
ANCHOR = 64
#: Segment bytes sorted at once, about, and segments of one anchor that are sorted together at most.
BUCKET_BYTES, MOST_SEGMENTS = 1 << 18, 1 << 10
#: Windows of the pieces that segments of an anchor with more are cut into, step by step.
PIECES = (16, 1)
#: Rows' names are broadcast up to this many (about 25 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ranges of pieces are broadcast up to this many (about 15 MB).
BROADCAST_RANGES = 250_000
#: Bytes searched for anchors at once: a place takes so many bits, and the other bits of a number are the hash's, for texts of any length.
PLACE_BITS = 24


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array to a depth: positions by the first depth bytes of their suffixes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. The others are induced by one scan of the buckets of first
    bytes from left to right: when a suffix is met in order, the one that begins a byte before it, if larger than it, is
    next in its own bucket. Bytes must be at least 1.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if the next other byte is greater; the end counts as least
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    run = np.searchsorted(change, np.arange(n))
    after = np.concatenate([text, [0]])[change + 1]
    small = after[run] > text
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(small)
    if len(direct):
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
        direct = direct[np.argsort(keys, kind="stable")]
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(met: np.ndarray, own: int) -> np.ndarray:
        """Puts what stands before met into its buckets; returns the part for the bucket being scanned."""
        before = met[met > 0] - 1
        before = before[~small[before]]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        if not len(before):
            return before
        edges = np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [len(head)]])
        mine = before[:0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if head[lo] == own:
                mine = before[lo:hi]
            else:
                induced[head[lo]].append(before[lo:hi])
        return mine

    for c in range(256):
        queue, at = induced[c], 0
        while at < len(queue):
            out.append(queue[at])
            if len(more := induce(queue[at], c)):
                queue.append(more)
            at += 1
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, depth at most, of each suffix in order with the one before it (0 for the first)."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 15):
        differ = windows[order[lo : lo + (1 << 15)]] != windows[order[lo - 1 : min(lo + (1 << 15), len(order)) - 1]]
        out[lo : lo + (1 << 15)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Of each segment, the starts of strings of length bytes that also start elsewhere in the segments."""
    text = np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes) - sizes
    valid = np.zeros(len(text), bool)
    for b, s in zip(begins, sizes):
        valid[b : b + max(0, s - length + 1)] = True
    order = suffix_order(text, length)
    order = order[valid[order]]
    same = common_prefixes(text, order, length) >= length
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    marked = np.zeros(len(text), bool)
    marked[order[repeated]] = True
    return [np.flatnonzero(marked[b : b + s]) for b, s in zip(begins, sizes)]


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_KEPT: dict[str, np.ndarray] = {}


def _rolled(buffer: np.ndarray, width: int) -> np.ndarray:
    """A number for each string of width bytes, from its bytes alone. It only orders and groups strings; what is equal is decided by bytes."""
    n = len(buffer) + 1
    if len(_KEPT.get("up", ())) < n:
        _KEPT["up"], _KEPT["down"] = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[buffer] * _KEPT["up"][: n - 1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _KEPT["down"][: n - width])


def _anchor_places(buffer: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each string of anchor bytes, place of each window's anchor)."""
    hashes = _rolled(buffer, anchor)
    width = length - anchor + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    # the upper hash bits, then the place: the least is the leftmost of the least-hashed
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    n = len(buffer) - length + 1
    least = np.minimum(least[:n], least[width - have : width - have + n])
    return hashes, (least & low).astype(np.int64)


def anchors(part: Slice, length: int, anchor: int, most: int = 1 << PLACE_BITS) -> tuple[np.ndarray, ...]:
    """(hash, row, first start, last start, segment hash, segment begin, segment end, anchor) of each run of windows with one anchor.

    A window's anchor depends on its bytes alone, so windows of equal bytes have equal anchors, equally placed, in texts of any length.
    """
    n = len(part.buffer)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    hashes, places = [], []
    for first in range(0, n - length + 1, most - length + 1):
        own, place = _anchor_places(part.buffer[first : first + most], length, anchor)
        places.append(place + first)
        hashes.append(own if first + most >= n else own[: most - length + 1])
    hashes, place = np.concatenate(hashes), np.concatenate(places)
    starts = np.arange(n - length + 1)
    sizes = np.diff(part.offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(starts)]
    inside = starts + length <= np.repeat(part.offsets[1:], sizes)[: len(starts)]
    starts, row, place = starts[inside], row[inside], place[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    begin, end = starts[new], starts[last] + length
    zero = part.offsets[row[new]]
    return hashes[place[new]].view(np.int64), row[new], begin - zero, starts[last] - zero, span_hash(part.buffer, begin, end).view(np.int64), begin, end, place[new]


def _text_key(text: bytes) -> int:
    """With the row's name, tells texts apart."""
    return xxhash.xxh3_64_intdigest(text) & ((1 << 63) - 1)


def _emit_anchors(length: int, anchor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for part in slices(batch.column("text")):
                h, row, *_ = anchors(part, length, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc[part.first + row])], names=["h", "doc"])

    return emit


def _emit_segments(length: int, anchor: int, with_bytes: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, s, segment, anchor's place in it) or (h, s, doc, key, lo, hi) of the anchors listed."""
        for batch in batches:
            doc, listed = batch.column("doc").to_numpy(), batch.column("hashes")
            for part in slices(batch.column("text")):
                h, row, lo, hi, s, begin, end, place = anchors(part, length, anchor)
                keep = np.zeros(len(h), bool)
                cut = np.searchsorted(row, np.arange(part.last - part.first + 1))
                for i in range(part.last - part.first):
                    if cut[i + 1] > cut[i]:
                        keep[cut[i] : cut[i + 1]] = np.isin(h[cut[i] : cut[i + 1]], listed[part.first + i].values.to_numpy())
                base = [pa.array(h[keep]), pa.array(s[keep])]
                if with_bytes:
                    raw = part.buffer.tobytes()
                    yield pa.RecordBatch.from_arrays([*base, pa.array([raw[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist())], pa.binary()), pa.array(place[keep] - begin[keep])], names=["h", "s", "segment", "anchor"])
                else:
                    key = np.array([_text_key(part.buffer[a:b].tobytes()) for a, b in zip(part.offsets[:-1], part.offsets[1:])], np.int64)
                    yield pa.RecordBatch.from_arrays([*base, pa.array(doc[part.first + row[keep]]), pa.array(key[row[keep]]), pa.array(lo[keep]), pa.array(hi[keep])], names=["h", "s", "doc", "key", "lo", "hi"])

    return emit


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()))


def _sort_bucket(length: int):
    def sort(table: pa.Table) -> pa.Table:
        """(h, s, first, last): runs of repeated starts in the segments of a bucket."""
        h, s = table.column("h").to_pylist(), table.column("s").to_pylist()
        rows = [(h[i], s[i], a, b) for i, starts in enumerate(repeated_starts(table.column("segment").to_pylist(), length)) for a, b in _runs(starts)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("h", "s", "first", "last"), columns)})

    return sort


def _pieces(length: int, step: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h2, s2, segment, anchor, h, s, at, n): segments in pieces of at most step windows, by their distance to the anchor.

        Pieces at one distance share what all their windows have: h2 names these bytes, so equal windows come under equal names.
        """
        for batch in batches:
            out: list[tuple] = []
            for h, s, n, segment, anchor in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "n", "segment", "anchor"))):
                last = len(segment) - length
                for q in range((anchor - last) // step, anchor // step + 1):
                    first, stop = max(0, anchor - q * step - step + 1), min(last, anchor - q * step)
                    core = anchor - q * step
                    piece = segment[first : stop + length]
                    out.append((xxhash.xxh3_64_intdigest(segment[core : core - step + 1 + length], q & 0xFFFF), xxhash.xxh3_64_intdigest(piece, stop - first), piece, anchor - first, h, s, first, n))
            columns = list(zip(*out)) if out else [()] * 8
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([signed(columns[0]), signed(columns[1]), pa.array(columns[2], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[3:]]], names=["h2", "s2", "segment", "anchor", "h", "s", "at", "n"])

    return pieces


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the spans listed."""
    for batch in batches:
        kept, n_bytes, removed, spans = [], [], [], []
        for text, listed in zip(batch.column("text"), batch.column("spans")):
            raw = bytes(text.as_buffer()) if text.is_valid else b""
            own = []
            if listed.is_valid:
                key = _text_key(raw)
                for x in sorted((x["lo"], x["hi"]) for x in listed.as_py() if x["key"] == key):
                    if own and x[0] <= own[-1][1]:
                        own[-1] = own[-1][0], max(own[-1][1], x[1])
                    else:
                        own.append(x)
            at, pieces = 0, []
            for a, b in own:
                pieces.append(raw[at:a])
                at = b
            kept.append(b"".join([*pieces, raw[at:]]))
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(kept[-1]))
            spans.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))],
            names=["id", "kept", "n_bytes", "n_removed", "spans"],
        )


def _repeats(segments: DataFrame, length: int, steps: tuple[int, ...]) -> DataFrame:
    """(h, s, first, last): runs of repeated starts of each segment (h, s, segment, anchor, n), whose equal ones are counted first."""
    # by bytes, not by hash
    segments = materialize(segments.groupBy("h", "s", "segment").agg(F.sum("n").alias("n"), F.max("anchor").alias("anchor")), "segments")
    per_anchor = segments.groupBy("h").agg(F.count("*").alias("variants"))
    # equal segments repeat in whole, the others where they are like another of their anchor
    whole = segments.where("n > 1").select("h", "s", F.lit(0).cast("long").alias("first"), (F.octet_length("segment") - length).cast("long").alias("last"))
    unlike = segments.join(per_anchor.where("variants > 1"), "h")
    few = unlike.where(F.col("variants") <= MOST_SEGMENTS) if steps else unlike
    buckets = int((few.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) // BUCKET_BYTES) + 1
    ordered = few.select("h", "s", "segment", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_sort_bucket(length), "h long, s long, first long, last long")
    out = whole.unionAll(ordered)
    if steps:
        many = unlike.where(F.col("variants") > MOST_SEGMENTS).select("h", "s", "n", "segment", "anchor")
        pieces = many.mapInArrow(_pieces(length, steps[0]), "h2 long, s2 long, segment binary, anchor long, h long, s long, at long, n long")
        below = _repeats(pieces.select(F.col("h2").alias("h"), F.col("s2").alias("s"), "segment", "anchor", "n"), length, steps[1:])
        below = materialize(below.select(F.col("h").alias("h2"), F.col("s").alias("s2"), "first", "last"), "piece-ranges")
        # a piece that most segments share is one key, so few ranges go to the pieces instead of meeting them
        named = pieces.select("h2", "s2", "h", "s", "at").join(F.broadcast(below) if below.count() <= BROADCAST_RANGES else below, ["h2", "s2"])
        out = out.unionAll(named.select("h", "s", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")))
    return out


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Documents without each byte covered by a string of `length` bytes that also starts anywhere else.

    Exact over whole texts as UTF-8 bytes; matches never cross documents. One suffix array of everything would hold a row per
    byte, so the bytes are dealt out first: each window of `length` bytes has an anchor, and equal windows have equal anchors.
    Anchors that occur once have no repeated window. The windows of one anchor in one place are a segment; segments of equal bytes
    would stand side by side in the array, all of them repeated, so they are counted with a map-side combine first. Different segments of an anchor go to one bucket, whose
    suffix array is made by two-stage sorting; adjacent common prefixes of `length` mark repeated windows. The
    segments of an anchor with more than MOST_SEGMENTS different ones are cut into pieces of fewer windows each, in two steps,
    and grouped again by the bytes that all windows of a piece share. Pieces of one window have a group for each content, so
    equal ones are all counted and no unlike ones are left to sort.

    Returns one row per input row: id, kept (remaining bytes; may cut a character), n_bytes, n_removed, spans (maximal removed
    runs, [start, end) in bytes). Null texts are empty; texts shorter than `length` are kept whole; equal rows repeat each
    other, so both lose all. Ids of any type, repeated or null, only go along: each row is a text of its own. An empty table gives
    no rows. Other columns are ignored. A text, and what it loses, fit one row (2 GB). Lowers the session's limits on Arrow batches (bound_batches).
    """
    bound_batches(documents.sparkSession)
    # a row's name: equal rows have one, and the same spans
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    long_rows = rows.where(F.octet_length("text") >= length)
    found = materialize(long_rows.select("doc", "text").mapInArrow(_emit_anchors(length, anchor), "h long, doc long"), "all-anchors")
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    listed = materialize(found.join(twice, "h").groupBy("doc").agg(F.collect_set("h").alias("hashes")), "candidates")
    discard(found, twice)
    ids = listed.select("doc")
    some = ids.count() <= BROADCAST_IDS
    near = F.broadcast(ids) if some else ids
    candidates = long_rows.select("doc", "text").join(near, "doc", "left_semi") if some else long_rows.select("doc", "text")
    candidates = candidates.join(listed, "doc").select("doc", "text", "hashes")
    places = materialize(candidates.mapInArrow(_emit_segments(length, anchor, False), "h long, s long, doc long, key long, lo long, hi long"), "places")
    segments = candidates.mapInArrow(_emit_segments(length, anchor, True), "h long, s long, segment binary, anchor long").withColumn("n", F.lit(1).cast("long"))
    spans = materialize(_repeats(segments, length, PIECES), "ranges")
    # of equal rows, each range once
    lost = places.join(spans, ["h", "s"]).select("doc", "key", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + length).alias("hi")).distinct()
    lost = materialize(lost.groupBy("doc").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("spans")), "spans")
    discard(places, spans)
    none = F.lit(None).cast("array<struct<key: bigint, lo: bigint, hi: bigint>>").alias("spans")
    if some:
        done = rows.join(near, "doc", "left_semi").join(lost, "doc", "left").select("id", "text", "spans").unionAll(rows.join(near, "doc", "left_anti").select("id", "text", none))
    else:
        done = rows.join(lost, "doc", "left").select("id", "text", "spans")
    out = done.mapInArrow(_cut, f"id {rows.schema['id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 200 bytes by its place, in hexadecimal; texts are cut into blocks first, so that places are found without counting from the start.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT row, n, b, substr(h, 2 * b + 1, 2400) AS x FROM (SELECT row, n, h, unnest(range(0, n - 199, 1000)) AS b FROM d WHERE n >= 200)),
w AS (SELECT row, b + i AS i, hash(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT row, b, x, unnest(range(0, least(1000, n - 199 - b))) AS i FROM blocks)),
r AS (SELECT row, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
runs AS (SELECT row, min(i) AS s, max(i) + 200 AS e FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM marked) GROUP BY row, run),
kept AS (
  SELECT row, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 0) AS a, s AS z FROM runs
  UNION ALL SELECT d.row, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN runs USING (row) GROUP BY d.row
),
parts AS (SELECT row, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k FROM kept JOIN d USING (row) GROUP BY row),
sums AS (SELECT row, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY row)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN parts USING (row) LEFT JOIN sums USING (row)
"""
