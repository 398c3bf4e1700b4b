"""Links of ids that have several texts, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.ngram_join import ngram_components
from tessera.llm.storage import join_frequent


def _sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _plain(rows):
    """(id, component) of rows (id, text): rows of one id are one node with the links of each of its texts."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, _sets(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return Counter((i, root(i)) for i, _ in rows)


def test_a_long_text_of_the_same_id_hides_no_link(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: 39 - i % 2], f"e{i}"])) for i in range(1, 31)]
    long = " ".join(f"x{i}" for i in range(3000))
    rows += [(50, " ".join(base)), (50, long), (60, " ".join(f"x{i}" for i in range(1000)))]
    got = Counter(map(tuple, ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == _plain(rows) and got[50, 1] == 2


def test_random_tables_of_repeated_ids(spark):
    """200 tables at once, each with words and ids of its own; texts of unlike lengths, empty ones and copies among the rows of an id."""
    rows, want = [], Counter()
    for k in range(200):
        rng = random.Random(k)
        bases = [[f"t{k}w{rng.randrange(10**4)}" for _ in range(rng.choice([3, 7, 30, 120]))] for _ in range(4)]
        table = []
        for _ in range(14):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"t{k}e{rng.randrange(10**6)}"
            table.append((k * 100 + rng.randrange(9), rng.choice([" ".join(w)] * 9 + ["", None])))
        rows += table
        want += _plain(table)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.select("doc_id", "component_id").collect())) == want


def test_frequent_keys_join_whole(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 11")
    for share in (1, 10, 10_000):
        assert join_frequent(left, right, "k", "n", share).count() == left.where("k <> 11").count()
