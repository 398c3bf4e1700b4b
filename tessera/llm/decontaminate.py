"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import bound_batches, discard, materialize
from tessera.llm.tokens import ALNUM, slices, word_hashes, words

#: Words of a window.
WINDOW = 10
#: A proximity match has each word of a window within this many words of its place.
SLOP = 1
#: Lists that are intersected by joins, from the rarest; texts with what is left are read.
LISTS = 3
#: Candidate places that are compared at once.
CHECKED = 1 << 16
#: Terms are broadcast up to this many (8 MB); beyond, all words are counted and indexed, and joined with the terms.
BROADCAST_TERMS = 1_000_000
#: Keys of texts are broadcast up to this many, and lists of candidates and of matches up to this many entries in all (some 25 MB each); beyond, they are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_ENTRIES = 500_000, 150_000


def _windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, terms) of each window of each item."""
        for batch in batches:
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                term = word_hashes(part, found, ALNUM).view(np.int64)
                ends = np.cumsum(found.per_row)
                items, sizes, at = [], [], []
                for row, n in enumerate(found.per_row.tolist()):
                    size = min(n, window)
                    starts = np.arange(ends[row] - n, ends[row] - size + 1) if n else np.zeros(0, np.int64)
                    items.append(np.full(len(starts), part.first + row))
                    sizes.append(np.full(len(starts), size))
                    at.append((starts[:, None] + np.arange(size)).ravel())
                items, sizes, at = (np.concatenate(x).astype(np.int64) for x in (items, sizes, at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(term[at]))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(items)), lists], names=["item", "terms"])

    return cut


def _known(term: np.ndarray, shared: Broadcast | None) -> np.ndarray:
    """Which words are among the broadcast terms; all without such."""
    if shared is None:
        return np.ones(len(term), bool)
    known = shared.value
    if not len(known):
        return np.zeros(len(term), bool)
    return known[np.minimum(np.searchsorted(known, term), len(known) - 1)] == term


_COUNTED = "id {}, key long, n_words long, term long, n long"


def _count(shared: Broadcast | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text (id, key, n_words) and for each term of a slice (term, n)."""
        for batch in batches:
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                term = word_hashes(part, found, ALNUM).view(np.int64)
                term, n = np.unique(term[_known(term, shared)], return_counts=True)
                rows, none = part.last - part.first, len(term)
                both = lambda column: pa.concat_arrays([column.slice(part.first, rows), pa.nulls(none, column.type)])  # noqa: B023, E731
                more = lambda values: pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(values.astype(np.int64))])  # noqa: B023, E731
                counted = pa.concat_arrays([pa.array(found.per_row), pa.nulls(none, pa.int64())])
                yield pa.RecordBatch.from_arrays([both(batch.column("id")), both(batch.column("key")), counted, more(term), more(n)], names=["id", "key", "n_words", "term", "n"])

    return count


def _post(shared: Broadcast | None):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, key, at): where words stand in texts."""
        for batch in batches:
            key = batch.column("key").to_numpy()
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                term = word_hashes(part, found, ALNUM).view(np.int64)
                at = np.arange(len(term)) - np.repeat(np.cumsum(found.per_row) - found.per_row, found.per_row)
                keep = _known(term, shared)
                yield pa.RecordBatch.from_arrays([pa.array(term[keep]), pa.array(key[part.first + found.rows[keep]]), pa.array(at[keep].astype(np.int32))], names=["term", "key", "at"])

    return post


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Union of intervals."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    stop = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return [{"start": a, "end": b} for a, b in zip(starts[new].tolist(), reach[stop].tolist())]


def _matches(term: np.ndarray, start: np.ndarray, wanted: np.ndarray, sizes: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact, near) of windows (rows of wanted, of so many terms) placed at starts in a text's terms."""
    exact, near = np.ones(len(start), bool), np.ones(len(start), bool)
    for k in range(wanted.shape[1]):
        own, close = k >= sizes, k >= sizes
        for d in range(-slop, slop + 1):
            p = start + k + d
            hit = (p >= 0) & (p < len(term))
            hit[hit] = term[p[hit]] == wanted[hit, k]
            close = close | hit
            if d == 0:
                own = own | hit
        exact &= own
        near &= close
    return exact, near


def _verify(slop: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, spans of exact matches, windows found exactly, windows found near by) of texts with candidates (window, starts, terms)."""
        for batch in batches:
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                every = word_hashes(part, found, ALNUM).view(np.int64)
                ends = np.cumsum(found.per_row)
                spans, exact, near = [], [], []
                for i in range(part.last - part.first):
                    listed = batch.column("listed")[part.first + i].values
                    lists, terms = listed.field("starts"), listed.field("terms")
                    counts, sizes = (x.value_lengths().to_numpy().astype(np.int64) for x in (lists, terms))
                    table = np.zeros((len(sizes), sizes.max()), np.int64)
                    table[np.arange(table.shape[1]) < sizes[:, None]] = terms.flatten().to_numpy()
                    which, start = np.repeat(np.arange(len(sizes)), counts), lists.flatten().to_numpy().astype(np.int64)
                    text, own, close = every[ends[i] - found.per_row[i] : ends[i]], np.zeros(len(start), bool), np.zeros(len(start), bool)
                    for at in range(0, len(start), CHECKED):
                        rows = which[at : at + CHECKED]
                        own[at : at + CHECKED], close[at : at + CHECKED] = _matches(text, start[at : at + CHECKED], table[rows], sizes[rows], slop)
                    wid, sizes = listed.field("wid").to_numpy()[which], sizes[which]
                    spans.append(_merge(start[own], (start + sizes)[own]))
                    exact.append(np.unique(wid[own]).tolist())
                    near.append(np.setdiff1d(wid[close], wid[own]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(part.first, part.last - part.first), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(exact, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                    names=["key", "spans", "exact", "near"],
                )

    return verify


def _shipped(terms: DataFrame, limit: int) -> Broadcast | None:
    """A broadcast of some distinct terms, none if they are more than limit."""
    if terms.count() > limit:
        return None
    return terms.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow().column(0).to_numpy()))


def _small(df: DataFrame, *lists: str) -> DataFrame:
    """For a broadcast if its lists, and so its rows, are few."""
    n = df.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(1)))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ENTRIES else df


def build_index(texts: DataFrame, terms: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(term, key, positions): the positional inverted index of texts (key, text) for some terms (term), a list for each term and text, stored.

    Texts of one key count once. Lists are cut by text, so that a term of a third of all texts is a third of all rows, which are
    dealt out by term and key.
    """
    shared = _shipped(terms, limit)
    posted = texts.mapInArrow(_post(shared), "term long, key long, at int")
    if shared is None:
        posted = posted.join(terms, "term", "left_semi")
    out = materialize(posted.groupBy("term", "key").agg(F.array_sort(F.collect_set("at")).alias("positions")), "postings")
    if shared is not None:
        shared.destroy()
    return out


def _items(found: DataFrame, wids: str, owners: DataFrame, name: str) -> DataFrame:
    """(key, sorted items) that own windows found in texts."""
    return found.select("key", F.explode(wids).alias("wid")).join(owners, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias(name))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = SLOP, limit: int = BROADCAST_TERMS,
) -> DataFrame:
    """Documents with what the benchmark's items and they have in common.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive
    words of an item; an item of fewer, but not none, is one window. Windows are cut on executors, and equal ones are one.
    1. The benchmark's terms are counted over all documents; a window with a term of no document goes.
    2. Of each window the LISTS rarest terms are indexed: a list of positions for each term and text, stored.
    3. Lists are intersected from the rarest: its positions, offset by the term's place in the window, are candidate starts, and those go on
       at which the next list has its term, too, within slop.
    4. Texts with candidates left are read, and all words of each window compared: exactly, and within slop.
    Texts are known by a 64-bit hash, so equal ones are searched once. What is joined grows with candidates; nothing of the
    benchmark but a checked number of terms reaches the driver.

    Returns one row per document: id, text_key (the hash of its text), n_words, spans (maximal runs of words inside windows found, [start, end)), items
    (sorted ids of items with windows found), near (items with a proximity match only: a start such that each word of a window
    stands at most slop words from its place). Null or empty texts and items have no words; null item ids count as the id "".
    Item ids are compared as strings, document ids of any type go along. Repeated rows give repeated rows, repeated items count
    once; an empty benchmark gives no hits and an empty table no rows. Other columns are ignored. A text's candidates fit one
    row (2 GB). Lowers the session's limits on Arrow batches (bound_batches).
    """
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    cut = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).mapInArrow(_windows(window), "item string, terms array<long>")
    cut = materialize(cut.select("item", F.xxhash64("terms").alias("wid"), "terms").distinct(), "windows")
    owners = cut.select("wid", "item").distinct()
    distinct = cut.select("wid", "terms").dropDuplicates(["wid"])
    vocabulary = materialize(cut.select(F.explode("terms").alias("term")).distinct(), "terms")
    shared = _shipped(vocabulary, limit)
    counted = rows.mapInArrow(_count(shared), _COUNTED.format(rows.schema["id"].dataType.simpleString()))
    counted = materialize(counted, "words")
    texts = counted.where("term IS NULL").select("id", "key", "n_words")
    rare = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    # windows whose terms all occur, with their terms' places from the rarest
    placed = distinct.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term")).join(rare, "term")
    alive = placed.groupBy("wid", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "place", "term"))), 1, LISTS).alias("rare"), F.count("*").alias("held")).where("held = size").select("wid", "rare")
    alive = materialize(alive, "rare-terms")
    selected = materialize(alive.select(F.explode("rare.term").alias("term")).distinct(), "rare")
    index = build_index(rows.select("key", "text"), selected, limit)
    starts = lambda positions, place: F.flatten(F.transform(positions, lambda p: F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: p - place + d)))
    met = alive.select("wid", "rare", F.col("rare")[0]["term"].alias("term")).join(index, "term").select("wid", "rare", "key", F.array_distinct(starts(F.col("positions"), F.col("rare")[0]["place"])).alias("starts"))
    for k in range(1, LISTS):
        # windows of fewer terms than lists go on as they are
        more, done = met.where(F.size("rare") > k), met.where(F.size("rare") <= k)
        # hashed, so that a word repeated through a text costs its length and not its square
        near = F.array_intersect("starts", starts(F.col("positions"), F.col("rare")[k]["place"]))
        more = more.withColumn("term", F.col("rare")[k]["term"]).join(index, ["term", "key"]).select("wid", "rare", "key", near.alias("starts")).where(F.size("starts") > 0)
        met = more.unionAll(done)
    listed = met.join(distinct, "wid").groupBy("key").agg(F.collect_list(F.struct("wid", "starts", "terms")).alias("listed"))
    listed = materialize(listed, "candidates")
    keys = listed.select("key")
    near_texts = rows.select("key", "text").join(F.broadcast(keys), "key", "left_semi") if keys.count() <= BROADCAST_KEYS else rows.select("key", "text")
    # copies are one before they move, so no text is a heavy key
    near_texts = near_texts.groupBy("key").agg(F.any_value("text").alias("text"))
    found = near_texts.join(listed, "key").mapInArrow(_verify(slop), "key long, spans array<struct<start: long, end: long>>, exact array<long>, near array<long>")
    found = materialize(found.where((F.size("exact") > 0) | (F.size("near") > 0)), "matches")
    named = found.select("key", "spans").join(_items(found, "exact", owners, "items"), "key", "left").join(_items(found, "near", owners, "close"), "key", "left")
    named = materialize(named, "contaminated")
    discard(cut, vocabulary, alive, selected, index, listed, found)
    if shared is not None:
        shared.destroy()
    none = F.array().cast("array<string>")
    out = texts.join(_small(named, "spans", "items", "close"), "key", "left")
    items = F.coalesce("items", none)
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "n_words", F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"), items.alias("items"), F.array_except(F.coalesce("close", none), items).alias("near"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near (items with a proximity match only)."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


#: SQL of op2: words and windows by position. Doc words inside an occurrence of a window are hit; near matches are looked for around each occurrence of a window's first word.
def op2_ctes(docs: str, window: int = WINDOW, slop: int = SLOP) -> str:
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = f"least({window}, len(w))"
    return f"""
bench AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({lower}, '{pattern}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT item, {n} AS k, list_slice(w, i, i + {n} - 1) AS g FROM (SELECT item, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM bench WHERE len(w) > 0)),
worded AS (SELECT doc_id, coalesce(regexp_extract_all({lower}, '{pattern}'), []) AS w FROM {docs}),
lens AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, lens WHERE len(w) >= k)),
found AS (SELECT DISTINCT doc_id, i, grams.k, item FROM grams JOIN windows ON grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
present AS (SELECT DISTINCT g, k FROM windows),
said AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM worded),
placed AS (SELECT DISTINCT doc_id, g, k, i + d AS s FROM said JOIN present ON x = g[1], (SELECT unnest(range(-{slop}, {slop} + 1)) AS d)),
close AS (SELECT DISTINCT doc_id, g FROM placed JOIN worded USING (doc_id) WHERE k < 2 OR (list_contains(w[greatest(s + 1 - {slop}, 1):s + 1 + {slop}], g[2]) AND len(list_filter(range(3, k + 1), lambda p: NOT list_contains(w[greatest(s + p - 1 - {slop}, 1):greatest(s + p - 1 + {slop}, 0)], g[p]))) = 0)),
nearby AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item FROM close JOIN windows USING (g)) ANTI JOIN (SELECT DISTINCT doc_id, item FROM found) USING (doc_id, item) GROUP BY doc_id)"""


OP2_SQL = f"WITH {op2_ctes('documents')} SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near FROM worded LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN nearby USING (doc_id)"
