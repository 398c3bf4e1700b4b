"""Embedding near-duplicates against brute force."""

from collections import Counter

import numpy as np
import pytest

from tessera.llm.flat_graph import audit_recall, link_vectors, range_search, robust_graph

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, p1 long"


def _plain(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label), by all pairs."""

    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    units, n = [unit(r[1]) for r in rows], len(rows)
    links = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    out, part = [None] * n, {}
    for i in range(n):
        if i in part:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        for j in seen:
            part[j] = min(ids) if ids else None
    for i in range(n):
        out[i] = (rows[i][0], len(links[i]), part[i], rows[i][0] == part[i])
    return out


def _near(rng, base, k, noise):
    return base + rng.normal(size=(k, len(base))) * noise / np.sqrt(len(base))


def _table():
    rng = np.random.default_rng(3)
    vectors = list(rng.normal(size=(150, 16)))
    for size, noise in ((40, 0.12), (25, 0.15), (30, 0.1), (2, 0.05)):
        vectors += list(_near(rng, rng.normal(size=16) / 4, size, noise))
    rows = [(i, list(map(float, v)), i % 3 if i < 150 else 1 + i // 200) for i, v in enumerate(vectors)]
    v, label = rows[200][1], rows[200][2]
    odd = [(300, v, label), (301, v, label), (2, v, label), (302, [3e200 * x for x in v], label), (303, [-x for x in v], label), (None, v, label), (None, [5.0] * 16, label), (None, [5.0] * 16, 9), (None, [6.0] * 16, 9)]
    odd += [(310, None, 1), (311, [0.0] * 16, 1), (312, [-0.0] * 16, 1), (313, [float("nan")] * 16, 1), (314, [float("inf"), *v[1:]], label), (315, [None, *v[1:]], label), (316, [], 1), (317, v, None), (318, v[:8], label), (319, v[:8], label), (320, [0.0, 1.0], 1), (321, [-0.0, 1.0], 1), (310, [1.0], 1)]
    return rows + odd


def _given(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("shard", [2048, 24])
def test_links_are_all_pairs(spark, shard):
    """At 24 vectors a shard, shards are split again and again and groups of copies are dense."""
    rows = _table()
    got, want = [tuple(r) for r in link_vectors(_given(spark, rows), shard=shard).collect()], _plain(rows)
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)
    if shard == 2048:
        assert Counter(got) == Counter(want)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert true * 0.99 <= found <= true
    # no link that isn't there
    parts = {}
    for r in want:
        parts.setdefault(r[0], set()).add(r[2])
    assert all(r[2] is None or r[2] == r[0] or any(p is not None and p <= r[2] for p in parts[r[0]]) for r in got)


def test_a_dense_group_larger_than_a_shard_is_whole(spark):
    """A third of all vectors within range of one another, in blocks: every link of the group counts."""
    rng = np.random.default_rng(5)
    group = _near(rng, rng.normal(size=32) / 5.6, 300, 0.06)
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate([*group, *rng.normal(size=(600, 32))])]
    got = {r.vec_id: r for r in link_vectors(_given(spark, rows), shard=64).collect()}
    want = {r[0]: r for r in _plain(rows)}
    assert sum(want[i][1] for i in range(300)) == 300 * 299
    assert sum(got[i].n_links for i in range(300)) >= 0.99 * 300 * 299 and all(got[i].component_id == 0 for i in range(300))
    assert all(got[i].n_links == want[i][1] for i in range(300, 900))


def test_other_thresholds_and_no_rows(spark):
    rows = _table()
    assert Counter(map(tuple, link_vectors(_given(spark, rows), threshold=0.999).collect())) == Counter(_plain(rows, 0.999))
    assert link_vectors(_given(spark, rows).limit(0)).count() == 0
    lone = _given(spark, [(1, None, None), (None, None, 1)])
    assert Counter(map(tuple, link_vectors(lone).collect())) == Counter([(1, 0, 1, True), (None, 0, None, True)])


def test_audit_measures_recall(spark):
    rng = np.random.default_rng(8)
    bases = rng.normal(size=(60, 32))
    rows = [(i, list(map(float, v)), i % 2) for i, v in enumerate(v for b in bases for v in _near(rng, b / 5.6, 50, 0.1))]
    vectors = _given(spark, rows)
    linked = link_vectors(vectors, shard=128)
    audit = {r.label: r for r in audit_recall(vectors, linked, block=100).collect()}
    true = {r[0]: r[1] for r in _plain(rows)}
    for label in (0, 1):
        asked = [i for i in range(len(rows)) if i % 20 == 0 and i % 2 == label]
        if asked:
            assert (audit[str(label)].queries, audit[str(label)].links) == (len(asked), sum(true[i] for i in asked))
            assert audit[str(label)].recall >= 0.9
    half = linked.selectExpr("vec_id", "n_links DIV 2 AS n_links")
    assert all(r.recall < 0.51 for r in audit_recall(vectors, half).collect())


def test_graphs_are_reached_from_the_medoid_and_searches_are_whole():
    rng = np.random.default_rng(1)
    for u in (rng.normal(size=(700, 24)), np.repeat(rng.normal(size=(3, 8)), 90, axis=0), np.concatenate([_near(rng, b, 40, 0.2) for b in rng.normal(size=(9, 16))]), rng.normal(size=(1, 4)), rng.normal(size=(2, 4))):
        u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
        near = robust_graph(u)
        seen, todo = {0}, [0]
        while todo:
            for j in near[todo.pop()].tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert len(seen) == len(u) and all(i in near[j] for i in range(len(u)) for j in near[i])
        links = np.full((len(u), max(1, max(map(len, near)))), -1)
        for i, x in enumerate(near):
            links[i, : len(x)] = x
        entries = np.stack([np.zeros(len(u), np.int64), np.arange(len(u))], 1)
        found, true = range_search(u, links, np.arange(len(u)), entries, 0.9), u @ u.T >= 0.9
        assert not (found & ~true & (np.abs(u @ u.T - 0.9) > 1e-5)).any() and found.sum() >= 0.98 * true.sum()
