"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from tessera.llm.collocations import _vocabulary, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, least=10, most=3, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = {}
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(a, longer.get((lang, p[i : i + m]), 0))
    out = {}
    for (lang, p), a in candidates.items():
        if 100 * longer.get((lang, p), 0) >= inside * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def _texts():
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "é", "x y", "𝒳", "w" * 700, "b\x00c", "naïve", "Z"]
    rows = [(" ".join(rng.choices(words, [9, 3, 6, 5, 2, 2, 1, 1, 1, 1, 1], k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None])) for _ in range(150)]
    rows += [(". ".join(["new york city hall"] * 3) + "\nnew york\ttimes", "fr")] * 7 + [("a a a a a a a a a a a a", "one")] * 2 + [(None, "en"), ("", None), (" \t.,", "en"), ("the  of", "und")]
    return rows + [(" ".join(rng.choices(words[:4], k=20_000)), "en")]


@pytest.mark.parametrize(("flush", "group", "most", "top"), [(1 << 21, 1 << 21, 3, 2000), (50, 64, 3, 7), (333, 7, 4, 2000), (1000, 1 << 21, 2, 3)])
def test_phrases_are_plain_counts(spark, flush, group, most, top):
    rows = _texts()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n long").repartition(3)
    got = collocations(docs, most_words=most, top=top, flush=flush, group=group)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _plain(rows, most=most, top=top)


def test_no_rows_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0
    assert [tuple(r) for r in collocations(docs, least=1).collect()] == _plain([("a b c", "en")], least=1)


def test_codes_are_checked_over_all_words(spark, monkeypatch):
    """A seed that gives two words one code is passed over."""
    import tessera.llm.collocations as module

    plain = module._count_words

    def colliding(seed, flush):
        count = plain(seed, flush)
        if seed:
            return count

        def same_code(batches):
            import pyarrow as pa

            for b in count(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([7] * b.num_rows), b.column(2), b.column(3)], b.schema.names)

        return same_code

    monkeypatch.setattr(module, "_count_words", colliding)
    vocabulary, seed = _vocabulary(spark.createDataFrame([("a b", "en")], "text string, lang string"), 10)
    assert seed == 1 and vocabulary.select("code").distinct().count() == 2
