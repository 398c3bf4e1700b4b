"""Collocations by contiguous pattern growth over projected occurrence pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.storage import bound_batches, discard, materialize
from tessera.llm.tokens import Slice, Words, byte_class, mix, slices, word_hashes, words

#: Least occurrences of a candidate, most words, and the share of occurrences inside one longer phrase, in percent, that drops it.
LEAST, MOST_WORDS, INSIDE_PERCENT = 10, 3, 50
#: Phrases reported for each language.
TOP = 2000
#: Parts of a language that are ranked by themselves before it is.
RANK_PARTS = 64
#: Words that a task projects at once, and distinct windows of a group of prefixes, about.
FLUSH, GROUP = 1 << 21, 1 << 21
#: Ends a piece of text: no phrase crosses it.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLASSES = byte_class(b" \t" + PIECE_ENDS)
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
#: Language of texts that have none.
NO_LANG = "und"


def _span_strings(part: Slice, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans' bytes, lower-cased, as strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    data = _CLASSES[1][part.buffer[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Langs:
    """Numbers of the languages that a task has seen."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        here = [self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()]
        self.names = list(self.number)
        return np.asarray(here, np.int64)[coded.indices.to_numpy()]


def _slices(batch: pa.RecordBatch, langs: _Langs, seed: int) -> Iterator[tuple[Slice, Words, np.ndarray, np.ndarray]]:
    """(slice, its words, their codes, their languages)."""
    numbers = langs.of(batch.column("lang"))
    for part in slices(batch.column("text")):
        found = words(part, _CLASSES)
        yield part, found, word_hashes(part, found, _CLASSES, seed), numbers[part.first : part.last][found.rows]


def _count_words(seed: int, flush: int):
    """Mapper of (text, lang) to the occurrences of each word, summed over flush words."""

    def merged(held: list[tuple], langs: _Langs) -> pa.RecordBatch:
        lang, code, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        text = pa.concat_arrays([h[3] for h in held])
        order = np.lexsort((code, lang))
        first = _runs(lang[order], code[order])
        at = order[first]
        return pa.RecordBatch.from_arrays([pa.array(langs.names, pa.string()).take(pa.array(lang[at])), pa.array(code[at].view(np.int64)), text.take(pa.array(at)).cast(pa.string()), pa.array(np.add.reduceat(n[order], first))], ["lang", "code", "word", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, held, size = _Langs(), [], 0
        for batch in batches:
            for part, found, code, lang in _slices(batch, langs, seed):
                if not len(code):
                    continue
                order = np.lexsort((code, lang))
                first = _runs(lang[order], code[order])
                at = order[first]
                held.append((lang[at], code[at], np.diff(np.append(first, len(code))), _span_strings(part, found.starts[at], found.ends[at])))
                size += len(code)
                if size >= flush:
                    yield merged(held, langs)
                    held, size = [], 0
        if held:
            yield merged(held, langs)

    return count


def _pack(names: np.ndarray, windows: list[np.ndarray], counts: np.ndarray) -> tuple[bytes, int]:
    """Distinct windows as bytes: the codes of their words once, then a number for each place of each window."""
    used, place = np.unique(np.concatenate(windows), return_inverse=True)
    raw = np.asarray([len(used), len(counts)], np.int64).tobytes() + names[used].tobytes() + counts.astype(np.int64).tobytes() + place.astype(np.int32).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(data: bytes, size: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)
    n_names, n = raw[:16].view(np.int64)
    names, counts = raw[16 : 16 + 8 * n_names].view(np.uint64), raw[16 + 8 * n_names : 16 + 8 * (n_names + n)].view(np.int64)
    place = raw[16 + 8 * (n_names + n) :].view(np.int32).reshape(most, n)
    return [names[p] for p in place], counts


def _project(seed: int, groups: int, most: int, flush: int):
    """Mapper of (text, lang) to occurrence pointers, dealt out by prefixes of two words.

    A pointer is the window of most words from a place on, as growth reads it; past the end of its piece it holds 0. Equal
    windows of a flush are one pointer with a count. A row is the pointers of one group of prefixes.
    """

    def flushed(held: list[tuple], langs: _Langs) -> Iterator[tuple]:
        lang, code, linked = (np.concatenate([h[i] for h in held]) for i in range(3))
        names, number = np.unique(code, return_inverse=True)
        names, number = np.concatenate([[np.uint64(0)], names]), number.astype(np.int32) + 1
        windows, whole = [number], np.ones(len(code), bool)
        for k in range(1, most):
            whole = whole & np.append(linked[k - 1 :], np.zeros(k - 1, bool))
            windows.append(np.where(whole, np.append(number[k:], np.zeros(k, np.int32)), 0))
        start = np.flatnonzero(windows[1])
        windows = [w[start] for w in windows]
        with np.errstate(over="ignore"):
            group = mix(names[windows[0]] + mix(names[windows[1]])) % np.uint64(groups)
        order = np.lexsort((*reversed(windows), group, lang[start]))
        lang, group, windows = lang[start][order], group[order], [w[order] for w in windows]
        first = _runs(lang, group, *windows)
        counts = np.diff(np.append(first, len(order)))
        lang, group, windows = lang[first], group[first], [w[first] for w in windows]
        bounds = np.append(_runs(lang, group), len(first))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield (langs.names[lang[lo]], int(group[lo]), *_pack(names, [w[lo:hi] for w in windows], counts[lo:hi]))

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        block = []
        for row in found:
            block.append(row)
            if len(block) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block, strict=True)], ["lang", "bucket", "pointers", "size"])
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block, strict=True)], ["lang", "bucket", "pointers", "size"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, held, size = _Langs(), [], 0
        for batch in batches:
            for part, found, code, lang in _slices(batch, langs, seed):
                if not len(code):
                    continue
                piece = np.cumsum(_ENDS[part.buffer], dtype=np.int64)[found.starts]
                linked = np.append((piece[1:] == piece[:-1]) & (found.rows[1:] == found.rows[:-1]), False)
                held.append((lang, code, linked))
                size += len(code)
                if size >= flush:
                    yield from rows(flushed(held, langs))
                    held, size = [], 0
        if held:
            yield from rows(flushed(held, langs))

    return project


def _merge(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows in order, with their counts."""
    windows = [np.concatenate(w) for w in zip(*(p[0] for p in parts), strict=True)]
    counts = np.concatenate([p[1] for p in parts])
    order = np.lexsort(tuple(reversed(windows)))
    windows = [w[order] for w in windows]
    first = _runs(*windows)
    return [w[first] for w in windows], np.add.reduceat(counts[order], first)


def _extended(windows: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """(phrase, occurrences) of every frequent phrase of two words or more, depth first.

    windows are sorted, so the pointers of a prefix are a range of them, and those of its extensions are ranges within it.
    """
    most, before = len(windows), np.concatenate([[0], np.cumsum(counts)])

    def frequent(lo: int, hi: int, keys: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        first = lo + _runs(*(k[lo:hi] for k in keys))
        last = np.append(first[1:], hi)
        total = before[last] - before[first]
        for i in np.flatnonzero((total >= least) & (keys[-1][first] != 0)):
            yield int(first[i]), int(last[i]), int(total[i])

    def grow(lo: int, hi: int, total: int, length: int) -> Iterator[tuple[list[int], int]]:
        yield [int(w[lo].view(np.int64)) for w in windows[:length]], total
        if length < most:
            for a, b, n in frequent(lo, hi, [windows[length]]):
                yield from grow(a, b, n, length + 1)

    for lo, hi, total in frequent(0, len(counts), windows[:2]):
        yield from grow(lo, hi, total, 2)


def _grow(least: int, most: int, group_size: int):
    """Mapper of pointers, sorted by language and group, to frequent phrases; holds a group's distinct pointers at most."""

    def batch_of(lang: str, parts: list[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = list(_extended(*_merge(parts), least))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())], ["lang", "codes", "a"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, limit = None, [], 0, 2 * group_size
        for batch in batches:
            for lang, group, data, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "pointers", "size")), strict=True):
                if (lang, group) != key:
                    if parts:
                        yield from batch_of(key[0], parts)
                    key, parts, size, limit = (lang, group), [], 0, 2 * group_size
                parts.append(_unpack(data, raw, most))
                size += len(parts[-1][1])
                if size > limit:
                    parts = [_merge(parts)]
                    size = len(parts[0][1])
                    limit = max(2 * group_size, 2 * size)
        if parts:
            yield from batch_of(key[0], parts)

    return grow


def _vocabulary(texts: DataFrame, flush: int) -> tuple[DataFrame, int]:
    """(table (lang, code, word, f) of all words, seed of its codes); no two words share a code, which is checked over all of them."""
    for seed in range(64):
        counts = texts.mapInArrow(_count_words(seed, flush), "lang string, code long, word string, f long")
        vocabulary = materialize(counts.groupBy("lang", "code", "word").agg(F.sum("f").alias("f")), "words")
        shared = vocabulary.groupBy("code").agg(F.min("word").alias("x"), F.max("word").alias("y")).where("x <> y OR code = 0")
        if shared.isEmpty():
            return vocabulary, seed
        discard(vocabulary)
    raise ValueError("no seed gives every word a code of its own")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, inside_percent: int = INSIDE_PERCENT, top: int = TOP, flush: int = FLUSH, group: int = GROUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language of docs (text, lang, and any others).

    Phrases are 2 to most_words words of one piece, occurring least times or more. Texts are read twice: once for the words,
    whose codes are checked to tell all of them apart, and once for occurrence pointers, which are dealt out by prefix and
    grown to the right, depth first. Pointers with equal windows are one with a count, before and after the shuffle, so a
    frequent prefix comes as its distinct continuations; its pointers are merged as they stream in and never held at once.

    Null texts count as empty, null languages as NO_LANG; repeated rows count again. Without a frequent phrase a language has
    no rows. Counts up to 10^16 are exact. Phrases of equal score and occurrences stand by their UTF-8 bytes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    vocabulary, seed = _vocabulary(texts, flush)
    total = vocabulary.agg(F.sum("f")).first()[0] or 0
    pointers = texts.mapInArrow(_project(seed, 1 + total // group, most_words, flush), "lang string, bucket long, pointers binary, size long")
    dealt = pointers.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    phrases = materialize(dealt.mapInArrow(_grow(least, most_words, group), "lang string, codes array<long>, a long"), "phrases")

    # a part of a frequent phrase is frequent
    known = vocabulary.where(F.col("f") >= least).select("lang", F.array("code").alias("codes"), "f").unionAll(phrases.select("lang", "codes", F.col("a").alias("f")))
    cuts = phrases.select("lang", "codes", "a", F.explode(F.expr("sequence(1, size(codes) - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("slice(codes, 1, k)"), "tail": F.expr("slice(codes, k + 1, size(codes))")})
    cuts = cuts.join(known.select("lang", F.col("codes").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("codes").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "codes").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where("size(codes) > 2").select("lang", "a", F.explode(F.array(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes) - 1)"))).alias("codes"))
    longer = longer.groupBy("lang", "codes").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "codes"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))

    # parts of a language are ranked first, as its ranks are one task; ties at the end are all kept until their phrases are spelled
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    of_part = Window.partitionBy("lang", "part").orderBy(F.desc("cut.score"), F.desc("a"))
    first = kept.withColumn("part", F.pmod(F.xxhash64("codes"), F.lit(RANK_PARTS))).withColumn("place", F.rank().over(of_part)).where(F.col("place") <= top)
    first = materialize(first.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place", "part", "longer"), "first")
    spelled = first.select("lang", "codes", F.posexplode("codes").alias("pos", "code")).join(vocabulary.select("lang", "code", "word"), ["lang", "code"])
    spelled = spelled.groupBy("lang", "codes").agg(F.concat_ws(" ", F.expr("transform(sort_array(collect_list(struct(pos, word))), x -> x.word)")).alias("phrase"))
    sizes = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = first.join(spelled, ["lang", "codes"]).withColumn("rank", F.row_number().over(order.orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
    out = materialize(out, "collocations")
    discard(vocabulary, phrases, first)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


#: Phrases are counted as lists of words.
OP13_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM docs)),
words AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS x, [x] AS p FROM pieces) GROUP BY lang, p),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces),
phrases AS (
  SELECT lang, p, count(*) AS a FROM (SELECT lang, w[i:i + 1] AS p FROM starts UNION ALL SELECT lang, w[i:i + 2] FROM starts WHERE i + 2 <= len(w)) GROUP BY lang, p HAVING count(*) >= 10
),
known AS (SELECT lang, p, f FROM words UNION ALL SELECT lang, p, a FROM phrases),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM phrases) c JOIN known x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN known y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, p[1:2] AS p FROM phrases WHERE len(p) = 3 UNION ALL SELECT lang, a, p[2:3] FROM phrases WHERE len(p) = 3),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = lowest.lang AND i.p = lowest.p AND 100 * i.a >= 50 * lowest.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
