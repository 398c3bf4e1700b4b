"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, pairs of words over words over bytes, thresholded by language.

Counts, look-ups and answers move between tasks as arrays packed into rows, one row for a task and a shard of the model, so that a
shuffle holds four bytes for an n-gram of a document where a row of its own would hold thirty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import bound_batches, discard, materialize
from tessera.llm.tokens import ALNUM, Slice, Words, mix, slices, word_hashes, words

#: Bytes of a spelling's n-gram, and symbols that bytes are folded to.
ORDER, SYMBOLS = 4, 48
#: Share of a language's trusted documents whose perplexity is at or below the threshold.
QUANTILE = 0.995
#: Trusted documents at which a group's own quantile and that of the larger group weigh the same.
FEW = 10
#: Trusted bytes for a shard of pairs and words, about, and words that a task packs at once.
SHARD_BYTES, CHUNK = 3 << 20, 1 << 19
#: The model is looked up in this many rounds, each by a part of its shards, so that shuffle files of one round are on disk at a time.
ROUNDS = 4
#: Bytes of documents whose look-ups meet one copy of a shard, about; more look-ups get more copies.
COPY_BYTES = 32 << 20
#: Scores are broadcast up to this many texts, ids of trusted documents up to this many (some 10 MB each); beyond, they are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_IDS = 200_000, 1_000_000
#: Words are told apart by so many bits of their hash; this one stands before and after a text, and is spelled with this log probability.
BITS, BOUNDARY, BOUNDARY_SPELLED = 40, np.uint64(0x243F6A8885), -7.0
#: Log probabilities are whole numbers, so that sums are the same in any order: of bytes in 1024ths, of words in 256ths.
BYTE_SCALE, WORD_SCALE = 1024, 256
_PAIR, _WORD = np.uint64(0xA4093822299F31D1), np.uint64(0x082EFA98EC4E6C89)


def _symbols() -> np.ndarray:
    """Byte to symbol: 0 white space and control, 1-26 letters, 27 capitals, 28 digits, 29-31 bytes that begin a character, 32-39 bytes that go on, then punctuation by itself or together."""
    table = np.full(256, 47, np.int64)
    table[:33] = 0
    table[97:123] = np.arange(1, 27)
    table[65:91] = 27
    table[48:58] = 28
    table[0xC0:0xE0], table[0xE0:0xF0], table[0xF0:] = 29, 30, 31
    table[0x80:0xC0] = 32 + np.arange(64) % 8
    for k, c in enumerate(b".,'\"!?-"):
        table[c] = 40 + k
    return table


_TABLE = _symbols()


def _grams(part: Slice) -> np.ndarray:
    """Number of the n-gram that ends at each byte; before a text stands white space."""
    at = _TABLE[part.buffer]
    starts = part.offsets[:-1]
    out = at.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(at)
        shifted[back:] = at[:-back] if len(at) > back else at[:0]
        for k in range(back):  # what a text's first bytes would see of the text before
            first = starts + k
            first = first[first < part.offsets[1:]]
            shifted[first] = 0
        out += shifted * SYMBOLS**back
    return out


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, c0, c1): the partition's n-gram counts of both halves."""
    total = np.zeros((2, SYMBOLS**ORDER), np.uint32)
    for batch in batches:
        half = batch.column("half").to_numpy()
        for part in slices(batch.column("text")):
            g = _grams(part)
            of = np.repeat(half[part.first : part.last], np.diff(part.offsets))
            for k in (0, 1):
                seen, c = np.unique(g[of == k], return_counts=True)
                total[k, seen] += c.astype(np.uint32)
    seen = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(total[k, seen].astype(np.int64)) for k in (0, 1)]], names=["g", "c0", "c1"])


def discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """What n-grams of count 1, 2, and 3 or more give up, from the counts of counts; plain ones where these are nought, as on small texts."""
    y = ones / (ones + 2 * twos) if ones + twos else 0.5
    return np.array([0.0, *[min(max(i - (i + 1) * y * b / a, 0.1), i - 0.1) if a and b else 0.5 * i for i, a, b in ((1, ones, twos), (2, twos, threes), (3, threes, fours))]])


def _given_up(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, 3).astype(np.int64)]


def byte_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of every n-gram's last symbol after the others, from a count for each: interpolated modified Kneser-Ney, lower orders count distinct left neighbours."""
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        orders.append((orders[-1].reshape(SYMBOLS, SYMBOLS**k) > 0).sum(0).astype(np.uint32))
    dense = np.full(1, 1.0 / SYMBOLS, np.float32)
    for c in reversed(orders):
        d = discounts(*[int((c == i).sum()) for i in (1, 2, 3, 4)]).astype(np.float32)
        less = _given_up(d, c).reshape(-1, SYMBOLS)
        c = c.reshape(-1, SYMBOLS)
        total = c.sum(1).astype(np.float32)
        lower = np.tile(dense.reshape(-1, SYMBOLS), (len(c) // max(1, len(dense) // SYMBOLS), 1)) if len(dense) > 1 else np.full((1, SYMBOLS), dense[0], np.float32)
        share = np.where(total > 0, less.sum(1) / np.maximum(total, 1), 1).astype(np.float32)
        lower *= share[:, None]
        lower += (c - less) / np.maximum(total, 1)[:, None]
        dense = lower.ravel()
    return np.log(dense)


def train_bytes(trusted: DataFrame) -> np.ndarray:
    """Both halves' models of bytes, in BYTE_SCALE-ths: two tables of SYMBOLS ** ORDER numbers (21 MB together), whatever the corpus; and each half's bytes.

    Counts of all trusted text, summed by n-gram after a map-side combine; the driver gets a row for each possible n-gram at most.
    """
    counted = materialize(trusted.mapInArrow(_count_bytes, "g int, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")
    table = np.zeros((2, SYMBOLS**ORDER), np.int16)
    n_bytes = 0
    for k in (0, 1):
        found = counted.select("g", f"c{k}").toArrow()
        dense = np.zeros(SYMBOLS**ORDER, np.int64)
        dense[found.column(0).to_numpy()] = found.column(1).to_numpy()
        n_bytes += int(found.column(1).to_numpy().sum())
        del found
        table[k] = np.clip(np.round(byte_model(dense) * BYTE_SCALE), -32000, 0)
        pa.default_memory_pool().release_unused()
    discard(counted)
    return table, n_bytes


def _pack(x: np.ndarray) -> bytes:
    """Words' numbers in five bytes each."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _all(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The arrays packed in a column's rows, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _word_shard(x: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of words' numbers."""
    return ((x * np.uint64(n)) >> np.uint64(BITS)).astype(np.int64)


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _PAIR + w) & ~np.uint64(1)


def _pair_shard(key: np.ndarray, n: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _low(key: np.ndarray) -> np.ndarray:
    """What tells keys of a shard apart."""
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pairs(part: Slice, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, row) of each word and of the end of each text that has bytes."""
    n = np.where(np.diff(part.offsets) > 0, found.per_row + 1, 0)
    w = np.full(n.sum(), BOUNDARY)
    inner = np.ones(len(w), bool)
    inner[np.cumsum(n)[n > 0] - 1] = False
    w[inner] = word_hashes(part, found, ALNUM) >> np.uint64(64 - BITS)
    v = np.full(len(w), BOUNDARY)
    v[1:] = w[:-1]
    return v, w, np.repeat(np.arange(len(n)), n)


def _ranges(shard: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last) of each shard in a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(shard[lo]), lo, hi


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_COUNTED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_COUNTED_SQL = "kind int, shard int, a binary, b binary, c binary, d binary"


def _count_words(shared, n_shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0 (shard of pairs; words before, words, counts, halves) and of kind 1 (shard of words; words, sums of log probabilities as spelled by either model, how often)."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            v, w, half, x, spelled = (np.concatenate([h[i] for h in held]) if i < 4 else np.concatenate([h[4] for h in held], 1) for i in range(5))
            key, at, n = np.unique(_pair_key(v, w) | half, return_index=True, return_counts=True)
            rows = [(0, s, _pack(v[at[lo:hi]]), _pack(w[at[lo:hi]]), n[lo:hi].astype(np.uint32).tobytes(), half[at[lo:hi]].astype(np.uint8).tobytes()) for s, lo, hi in _ranges(_pair_shard(key, n_shards), n_shards)]
            x, of = np.unique(x, return_inverse=True)
            sums = [np.bincount(of, y, len(x)) for y in spelled]
            rows += [(1, s, _pack(x[lo:hi]), *[y[lo:hi].astype(np.float32).tobytes() for y in sums]) for s, lo, hi in _ranges(_word_shard(x, n_shards), n_shards)]
            return _batch(rows, _COUNTED)

        for batch in batches:
            halves = batch.column("half").to_numpy()
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                v, w, row = _pairs(part, found)
                x, of = np.unique(word_hashes(part, found, ALNUM) >> np.uint64(64 - BITS), return_inverse=True)
                g = _grams(part)
                sums = [np.concatenate([[0], np.cumsum(shared.value[k][g].astype(np.int64))]) for k in (0, 1)]
                spelled = [np.bincount(of, (s[found.ends] - s[found.starts]) / BYTE_SCALE, len(x)) for s in sums]
                held.append((v, w, halves[part.first + row].astype(np.uint64), x, np.stack([*spelled, np.bincount(of, minlength=len(x))])))
                size += len(v)
                if size >= CHUNK:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return count


def _table(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names.split(), columns, kinds)})


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and above nought."""
    return [*[int((counts == i).sum()) for i in (1, 2, 3, 4)], int((counts > 0).sum())]


_NAMES, _KINDS = "kind shard a b c d e of", [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
_SUMMED_SQL = "kind int, shard int, a binary, b binary, c binary, d binary, e binary, of array<long>"


def _sum_words(key: tuple, table: pa.Table) -> pa.Table:
    """A shard of pairs: its words, then by pair both words' places among them and counts in either half; or a shard of words: words, spellings."""
    kind, shard = (k.as_py() for k in key)
    if kind:
        x, of = np.unique(_unpack(b"".join(table.column("a").to_pylist())), return_inverse=True)
        *sums, n = (np.bincount(of, _all(table.column(c), np.float32), len(x)) for c in "bcd")
        return _table([(1, shard, _pack(x), *[(y / n).astype(np.float32).tobytes() for y in sums], b"", b"", [])], _NAMES, _KINDS)
    v, w = (_unpack(b"".join(table.column(c).to_pylist())) for c in "ab")
    n, half = _all(table.column("c"), np.uint32), _all(table.column("d"), np.uint8)
    _, at, of = np.unique(_pair_key(v, w), return_index=True, return_inverse=True)
    counts = [np.bincount(of, np.where(half == k, n, 0), len(at)) for k in (0, 1)]
    # four bytes for a count, eight in a shard that has a larger one
    counts = [c.astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.int64) for c in counts]
    v, w = v[at], w[at]
    x = np.unique(np.concatenate([v, w]))
    places = [np.searchsorted(x, y).astype(np.uint32).tobytes() for y in (v, w)]
    return _table([(0, shard, _pack(x), *places, *[c.tobytes() for c in counts], _of_counts(counts[0]) + _of_counts(counts[1]))], _NAMES, _KINDS)


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    pairs = len(row["b"]) // 4
    return _unpack(row["a"]), *[np.frombuffer(row[c], np.int64 if len(row[c]) > 4 * pairs else np.uint32).astype(np.int64) for c in "bcde"]


def _totals(df: DataFrame) -> np.ndarray:
    """The sums of the rows' counts of counts, by half."""
    out = np.zeros(10)
    for r in df.select(F.posexplode("of").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # ten rows
        out[r.i] = r.n
    return out.reshape(2, 5)


_STATS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("values", pa.binary())])


def _word_counts(d: list[np.ndarray], n_shards: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard of pairs, by word, for both halves: how often it comes first, what such pairs give up, and distinct words before it; of one of words, their spellings."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"]:
                    out.append((row["shard"], 1, row["a"], np.stack([np.frombuffer(row[c], np.float32) for c in "bc"]).tobytes()))
                    continue
                x, v, w, *n = _opened(row)
                of = [np.bincount(v, c, len(x)) for c in n] + [np.bincount(v, _given_up(d[k], n[k]), len(x)) for k in (0, 1)] + [np.bincount(w, c > 0, len(x)) for c in n]
                values = np.stack(of).astype(np.float32)
                out += [(s, 0, _pack(x[lo:hi]), values[:, lo:hi].tobytes()) for s, lo, hi in _ranges(_word_shard(x, n_shards), n_shards)]
            yield _batch(out, _STATS)

    return counts


def _sum_word_counts(key: tuple, table: pa.Table) -> pa.Table:
    """A shard of words: (words; by half: times first, given up, distinct words before, spelled)."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["a"], r["values"]))  # sums of fractions are of one order, whichever rows come first
    x = np.unique(np.concatenate([_unpack(r["a"]) for r in rows]))
    values = np.zeros((8, len(x)))
    values[6:] = BOUNDARY_SPELLED
    for r in rows:
        at = np.searchsorted(x, _unpack(r["a"]))
        got = np.frombuffer(r["values"], np.float32).reshape(-1, len(at))
        if r["kind"]:
            values[6:, at] = got
        else:
            values[:6, at] += got
    before = values[4:6].astype(np.int64)
    return _table([(0, key[0].as_py(), _pack(x), values.astype(np.float32).tobytes(), b"", b"", b"", _of_counts(before[0]) + _of_counts(before[1]))], _NAMES, _KINDS)


class Unigrams:
    """What words' probabilities need besides their own counts, by half."""

    def __init__(self, of: np.ndarray, pairs: np.ndarray) -> None:
        self.d = [discounts(*of[k, :4]) for k in (0, 1)]
        self.pairs = pairs
        freed = [self.d[k] @ [0, of[k, 0], of[k, 1], of[k, 4] - of[k, 0] - of[k, 1]] for k in (0, 1)]
        #: Log of the share of all that goes to words as they are spelled.
        self.new = [float(np.log(freed[k] / pairs[k])) if pairs[k] and freed[k] else 0.0 for k in (0, 1)]

    def values(self, raw: bytes) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By half, of a shard of words: log probability, its gain over the spelling plus the log of what the word as the one before leaves to others, and what its pairs give up."""
        t0, t1, f0, f1, m0, m1, s0, s1 = np.frombuffer(raw, np.float32).astype(np.float64).reshape(8, -1)
        logs, gains = [], []
        for k, (t, f, m, s) in enumerate(((t0, f0, m0, s0), (t1, f1, m1, s1))):
            known = (m - _given_up(self.d[k], m)) / max(1, self.pairs[k])
            logs.append(np.log(known + np.exp(self.new[k] + s)))
            gains.append(logs[-1] - self.new[k] - s + np.where(t > 0, np.log(np.maximum(f, 1e-30) / np.maximum(t, 1)), 0))
        return logs, gains, [f0, f1]


def _ask(n_shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard of words, kind 1, shard of pairs, words): what each shard of pairs has to know."""
        for batch in batches:
            yield _batch([(s, 1, row["shard"], _pack(x[lo:hi]), b"") for row in batch.select(["shard", "a"]).to_pylist() for x in [_unpack(row["a"])] for s, lo, hi in _ranges(_word_shard(x, n_shards), n_shards)], _ASKED)

    return ask


_ASKED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("origin", pa.int32()), ("a", pa.binary()), ("values", pa.binary())])
_ASKED_SQL = "shard int, kind int, origin int, a binary, values binary"


def _answer(unigrams: Unigrams):
    def answer(table: pa.Table) -> pa.Table:
        """(shard of pairs, shard of words, by word asked for: given up and log probability, by half)."""
        rows = table.to_pylist()
        own = next(r for r in rows if not r["kind"])
        x = _unpack(own["a"])
        logs, _, freed = unigrams.values(own["values"])
        values = np.stack([*freed, *logs]).astype(np.float32)
        out = [(r["origin"], own["shard"], values[:, np.searchsorted(x, _unpack(r["a"]))].tobytes()) for r in rows if r["kind"]]
        return _table(out, "origin shard values", [pa.int32(), pa.int32(), pa.binary()])

    return answer


_MODEL_NAMES, _MODEL_KINDS, _MODEL_SQL = "slot low value", [pa.int32(), pa.binary(), pa.binary()], "slot int, low binary, value binary"


def _entries(slot: int, low: np.ndarray, value: np.ndarray) -> tuple:
    order = np.argsort(low)
    return slot, low[order].tobytes(), np.clip(np.round(value[order] * WORD_SCALE), -32000, 32000).astype(np.int16).tobytes()


def _pair_gains(d: list[np.ndarray]):
    def gains(table: pa.Table) -> pa.Table:
        """The model's entries of a shard of pairs, by half: what a pair's log probability gains over its words'."""
        rows = table.to_pylist()
        own = next(r for r in rows if r["own"])
        x, v, w, *n = _opened(own)
        values = np.concatenate([np.frombuffer(r["values"], np.float32).reshape(4, -1) for r in sorted((r for r in rows if not r["own"]), key=lambda r: r["of"])], 1).astype(np.float64)
        low, out = _low(_pair_key(x[v], x[w])), []
        for k in (0, 1):
            some = np.flatnonzero(n[k])
            kept = n[k][some] - _given_up(d[k], n[k][some])
            out.append(_entries(2 * own["origin"] + k, low[some], np.log1p(kept / (values[k][v[some]] * np.exp(values[2 + k][w[some]])))))
        return _table(out, _MODEL_NAMES, _MODEL_KINDS)

    return gains


def _word_gains(unigrams: Unigrams):
    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's entries of words, by half."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                low = _low(mix(_unpack(row["a"]) ^ _WORD))
                out += [_entries(2 * row["shard"] + k, low, value) for k, value in enumerate(unigrams.values(row["b"])[1])]
            yield _batch(out, pa.schema(list(zip(_MODEL_NAMES.split(), _MODEL_KINDS))))

    return gains


def train_words(trusted: DataFrame, shared, n_shards: int) -> tuple[list[DataFrame], list[float]]:
    """(the model's entries, by rounds of its shards; log of what either half's model leaves to words as spelled).

    All pairs of all trusted texts count. A shard of pairs sums their counts in both halves. Words' counts go from the shards of
    pairs to those of words, and words' probabilities back to the pairs that asked, one entry for each word that a shard has: a word
    in a third of all pairs is asked for once by a shard, so no shard is large. Partitions are as many as shards, which grow with
    the trusted texts, whatever the session's number. An entry is four bytes of a hash and a gain:
    the log probability of a text is that of its bytes, its words as spelled, and the gains of its words and pairs.
    """
    counted = materialize(trusted.mapInArrow(_count_words(shared, n_shards), _COUNTED_SQL).repartition(2 * n_shards, "kind", "shard").groupBy("kind", "shard").applyInArrow(_sum_words, _SUMMED_SQL), "pairs", "zstd")
    pairs, spelled = counted.where("kind = 0"), counted.where("kind = 1")
    of = _totals(pairs)
    d = [discounts(*of[k, :4]) for k in (0, 1)]
    stats = counted.mapInArrow(_word_counts(d, n_shards), "shard int, kind int, a binary, values binary")
    vocabulary = materialize(stats.repartition(n_shards, "shard").groupBy("shard").applyInArrow(_sum_word_counts, _SUMMED_SQL), "words", "zstd")
    unigrams = Unigrams(_totals(vocabulary), of[:, 4])
    known = vocabulary.select("shard", F.lit(0).alias("kind"), F.lit(-1).alias("origin"), "a", F.col("b").alias("values"))
    model = []
    for r in range(ROUNDS):
        some = pairs.where(F.col("shard") % ROUNDS == r)
        answers = known.unionAll(some.mapInArrow(_ask(n_shards), _ASKED_SQL)).repartition(n_shards, "shard").groupBy("shard").applyInArrow(_answer(unigrams), "origin int, shard int, values binary")
        none = [F.lit(None).cast("binary").alias(c) for c in "abcde"]
        met = some.select(F.col("shard").alias("origin"), F.lit(-1).alias("of"), F.lit(True).alias("own"), *"abcde", none[0].alias("values")).unionAll(answers.select("origin", F.col("shard").alias("of"), F.lit(False).alias("own"), *none, "values"))
        entries = met.repartition(n_shards // ROUNDS, "origin").groupBy("origin").applyInArrow(_pair_gains(d), _MODEL_SQL)
        model.append(materialize(entries.unionAll(vocabulary.where(F.col("shard") % ROUNDS == r).mapInArrow(_word_gains(unigrams), _MODEL_SQL)), "word-model"))
    discard(counted, vocabulary)
    return model, unigrams.new


_LOOKED = pa.schema([("slot", pa.int32()), ("salt", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("value", pa.binary())])
_LOOKED_SQL = "slot int, salt int, chunk long, docs binary, sizes binary, low binary, value binary"


def _look_up(n_shards: int, r: int, copies: int):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for a shard: documents by their place in the chunk, number of entries of each, and the entries with how often the document has them; and a row of the chunk's documents, for no shard."""
        held: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        size = n_chunks = 0

        def packed() -> pa.RecordBatch:
            """held: document, slot and low bits in one number each, and how often."""
            keys, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            doc, of = np.concatenate([h[2] for h in held]), np.concatenate(docs)
            slot = (keys >> np.uint64(32)).astype(np.int64) & 0xFFFFF
            order = np.argsort(slot.astype(np.uint16) if 2 * n_shards < 1 << 16 else slot, kind="stable")
            slot, doc, low, counts = slot[order], doc[order], keys[order].astype(np.uint32), counts[order].astype(np.uint32)
            chunk = xxhash.xxh3_64_intdigest(of.tobytes()) - (1 << 63)
            out = [(-1, n_chunks % copies, chunk, of.tobytes(), None, None, None)]
            for s, lo, hi in _ranges(slot, 2 * n_shards):
                edges = np.concatenate([[0], np.flatnonzero(np.diff(doc[lo:hi])) + 1, [hi - lo]])
                out.append((s, n_chunks % copies, chunk, doc[lo:hi][edges[:-1]].astype(np.uint32).tobytes(), np.diff(edges).astype(np.uint32).tobytes(), low[lo:hi].tobytes(), counts[lo:hi].tobytes()))
            return _batch(out, _LOOKED)

        for batch in batches:
            names, halves = batch.column("key").to_numpy(), batch.column("half").to_numpy()
            for part in slices(batch.column("text")):
                v, w, row = _pairs(part, words(part, ALNUM))
                pair = _pair_key(v, w)
                half = (1 - halves[part.first + row]).astype(np.uint64)
                for shard, low in ((_pair_shard(pair, n_shards), _low(pair)), (_word_shard(v, n_shards), _low(mix(v ^ _WORD)))):
                    mine = np.flatnonzero(shard % ROUNDS == r)
                    key = (shard[mine].astype(np.uint64) * np.uint64(2) + half[mine]) << np.uint64(32) | low[mine]
                    at = row[mine]
                    for first in range(0, part.last - part.first, 4096):  # rows' numbers have twelve bits
                        a, b = np.searchsorted(at, [first, first + 4096])
                        every, n = np.unique((at[a:b] - first).astype(np.uint64) << np.uint64(52) | key[a:b], return_counts=True)
                        held.append((every, n, (every >> np.uint64(52)).astype(np.int64) + first + sum(map(len, docs))))
                docs.append(names[part.first : part.last])
                size += len(v)
                if size >= CHUNK:
                    yield packed()
                    held, docs, size, n_chunks = [], [], 0, n_chunks + 1
        if held:
            yield packed()

    return look_up


_GAINED = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, documents' places, sums of their entries' gains) by shard, and chunks' documents. Rows come by slot and salt, the model's entries first.

    A shard's entries come in any order. Of entries that share a key the least gain counts, so that a repeated task gives the same sums.
    """
    now, table = None, (np.zeros(0, np.uint32), np.zeros(0, np.int16))
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            place = row["slot"], row["salt"]
            if row["low"] is None:
                out.append((row["chunk"], row["docs"], None))
                continue
            low = np.frombuffer(row["low"], np.uint32)
            if row["docs"] is None:
                more = low, np.frombuffer(row["value"], np.int16)
                if now == place:
                    more = tuple(np.concatenate([a, b]) for a, b in zip(table, more))
                both = np.sort(more[0].astype(np.uint64) << np.uint64(16) | (more[1].astype(np.int64) + 32768).astype(np.uint64))
                now, table = place, ((both >> np.uint64(16)).astype(np.uint32), ((both & np.uint64(0xFFFF)).astype(np.int64) - 32768).astype(np.int16))
                continue
            if now != place or not len(table[0]):
                continue
            at = np.minimum(np.searchsorted(table[0], low), len(table[0]) - 1)
            gained = np.where(table[0][at] == low, table[1][at].astype(np.int64), 0) * np.frombuffer(row["value"], np.uint32)
            sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
            out.append((row["chunk"], row["docs"], np.add.reduceat(gained, np.cumsum(sizes) - sizes).tobytes()))
        yield _batch(out, _GAINED)


def _gather(table: pa.Table) -> pa.Table:
    """(key, gained) of a chunk's documents."""
    rows = table.to_pylist()
    keys = np.frombuffer(next(r["docs"] for r in rows if r["sums"] is None), np.int64)
    total = np.zeros(len(keys), np.int64)
    for r in rows:
        if r["sums"] is not None:
            np.add.at(total, np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["sums"], np.int64))  # a document comes once for its pairs and once for its words
    return pa.table({"key": pa.array(keys), "gained": pa.array(total)})


def _spell(shared, new: list[float]):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, base, bytes): log probability of each text's bytes and of its words as spelled, under the other half's model, in BYTE_SCALE-ths."""
        left = np.round(np.array(new) * BYTE_SCALE).astype(np.int64)
        for batch in batches:
            halves = batch.column("half").to_numpy()
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                sizes, model = np.diff(part.offsets), 1 - halves[part.first : part.last]
                spelled = shared.value[np.repeat(model, sizes), _grams(part)].astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(spelled)])
                base = sums[part.offsets[1:]] - sums[part.offsets[:-1]] + left[model] * (found.per_row + 1) + int(BOUNDARY_SPELLED * BYTE_SCALE)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(part.first, part.last - part.first), pa.array(base), pa.array(sizes)], names=["key", "base", "bytes"])

    return spell


def log_perplexities(documents: DataFrame, trusted: DataFrame, text_col: str) -> DataFrame:
    """(key, log_perplexity, size class) by distinct text, of key xxhash64(text): under the model of the trusted texts of the other half."""
    spark = documents.sparkSession
    keyed = lambda df: df.where(F.length(text_col) > 0).select(F.xxhash64(text_col).alias("key"), F.pmod(F.xxhash64(F.xxhash64(text_col)), F.lit(2)).cast("int").alias("half"), F.col(text_col).alias("text"))
    known, texts = keyed(trusted), keyed(documents)
    tables, n_bytes = train_bytes(known.select("half", "text"))
    shared = spark.sparkContext.broadcast(tables)
    n_shards = min(1 << 18, max(ROUNDS, n_bytes // SHARD_BYTES))
    model, new = train_words(known.select("half", "text"), shared, n_shards)
    bases = texts.mapInArrow(_spell(shared, new), "key long, base long, bytes long").groupBy("key").agg(F.max("base").alias("base"), F.max("bytes").alias("bytes"), F.count("*").alias("copies"))
    bases = materialize(bases, "spelled")
    all_bytes = bases.agg(F.sum(F.col("bytes") * F.col("copies"))).first()[0] or 0
    copies = int(all_bytes // (COPY_BYTES * n_shards)) + 1
    parts = []
    for r, entries in enumerate(model):
        none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "sizes")]
        copied = entries.select("slot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).cast("long").alias("chunk"), *none, "low", "value")
        met = copied.unionAll(texts.mapInArrow(_look_up(n_shards, r, copies), _LOOKED_SQL)).repartition(2 * n_shards * copies // ROUNDS, "slot", "salt").sortWithinPartitions("slot", "salt", F.col("docs").isNotNull())
        parts.append(materialize(met.mapInArrow(_probe, "chunk long, docs binary, sums binary").groupBy("chunk").applyInArrow(_gather, "key long, gained long"), "gained"))
        discard(entries)
    shared.destroy()
    gained = parts[0]
    for part in parts[1:]:
        gained = gained.unionAll(part)
    # equal texts have equal sums, so that theirs together is a whole number of times one's
    both = bases.join(gained.groupBy("key").agg(F.sum("gained").alias("gained")), "key", "left")
    total = F.col("base") / BYTE_SCALE + F.coalesce("gained", F.lit(0)) / F.col("copies") / WORD_SCALE
    out = materialize(both.select("key", F.round(-total / F.col("bytes"), 6).alias("log_perplexity"), F.floor(F.log2("bytes") / 2).cast("int").alias("size")), "scores")
    discard(bases, *parts)
    return out


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(level, lang, size, n, threshold) of scores (lang, size, log_perplexity): level 0 is of all together, 1 of a language, 2 of its texts of a class of size.

    Quantiles are of counts by log perplexity in thousandths, summed with a map-side combine; the same at each run.
    """
    bins = scores.where("log_perplexity IS NOT NULL").groupBy("lang", "size", F.ceil(F.col("log_perplexity") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    by_lang = bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", none("size", "int"), "bin", "n")
    of_all = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), none("lang", "string"), none("size", "int"), "bin", "n")
    bins = bins.select(F.lit(2).alias("level"), "lang", "size", "bin", "n").unionAll(by_lang).unionAll(of_all)
    of = Window.partitionBy("level", "lang", "size")
    ranked = bins.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("total", F.sum("n").over(of))
    return ranked.groupBy("level", "lang", "size").agg(F.min(F.when(F.col("upto") >= F.col("total") * quantile, F.col("bin"))).alias("high"), F.max("total").alias("n")).select("level", "lang", "size", "n", (F.col("high") / 1000).alias("threshold"))


def quality(documents: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Documents with their perplexity under a model of the trusted ones, and whether it is within their language's threshold.

    Texts are of one of two halves by a hash; a document is scored by the model of the trusted texts of the other half, so the
    trusted ones' perplexities, of which thresholds are quantiles, are of text not seen, as all others' are. The model is of
    pairs of words, over words, over words as spelled: pairs and words are all those of the trusted texts, in tables that grow with them,
    in shards; documents look up their distinct words and pairs, packed by shard, in ROUNDS rounds. Spelling, and what
    stands between words, is a model of four bytes folded to SYMBOLS symbols, a broadcast of 21 MB whatever the corpus.

    Returns one row per input row: rest (struct of the other input columns), text, log_perplexity (by byte), threshold, kept.
    The threshold of all leans to that of a language by n / (n + FEW), n its trusted texts; that in the same way to the one of the
    language's texts of like size (up to four times), as short texts' perplexities spread much more than long ones'.
    Null and empty texts have no perplexity and aren't kept. A language without trusted documents has the threshold of all,
    and null is a language; without any trusted document all texts that aren't empty are kept. Rows of a trusted id are all trusted, a
    null id never is. Repeated rows have the same result each, and an empty table gives no rows. Other columns, of whatever names,
    go into rest. Lowers the session's limits on Arrow batches (bound_batches).
    """
    spark = documents.sparkSession
    bound_batches(spark)
    ids = materialize(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("trusted")).where("trusted IS NOT NULL").distinct(), "trusted")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    trusted = documents.join(near, documents[id_col] == F.col("trusted"), "left_semi")
    scores = log_perplexities(documents, trusted, text_col)
    known = F.broadcast(scores) if scores.count() <= BROADCAST_TEXTS else scores
    judged = trusted.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("key")).join(known, "key")
    limits = materialize(thresholds(judged, quantile), "thresholds")
    overall = limits.where("level = 0").select(F.col("threshold").alias("overall")).first()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"), F.when(F.length(text_col) > 0, F.xxhash64(text_col)).alias("key"), F.col(lang_col).alias("of"))
    scored = rows.join(known, "key", "left")
    own = limits.where("level = 1").select(F.col("lang").alias("own_lang"), "n", "threshold")
    joined = scored.join(F.broadcast(own), F.col("of").eqNullSafe(F.col("own_lang")), "left")
    alike = limits.where("level = 2").select(F.col("lang").alias("alike_lang"), F.col("size").alias("alike_size"), F.col("n").alias("alike_n"), F.col("threshold").alias("alike"))
    joined = joined.join(F.broadcast(alike), F.col("of").eqNullSafe(F.col("alike_lang")) & (F.col("size") == F.col("alike_size")), "left")
    of_all = F.coalesce(F.lit(overall[0] if overall else None).cast("double"), F.lit(float("inf")))
    lean: Callable[[Column, str, str], Column] = lambda wide, own, n: F.coalesce(wide + (F.col(own) - wide) * F.col(n) / (F.col(n) + FEW), wide)
    limit = lean(lean(of_all, "threshold", "n"), "alike", "alike_n")
    return joined.select("rest", "text", "log_perplexity", limit.alias("threshold"), F.coalesce(F.col("log_perplexity") <= limit, F.lit(False)).alias("kept"))


def trusted_labels(spark, sf_dir: str) -> DataFrame:
    """Ids of documents labelled as good text and not as toxic; null is not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    done = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), trusted_labels(spark, sf_dir))
    return done.select("rest.doc_id", "rest.lang", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")
