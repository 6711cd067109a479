"""Nearest neighbours against brute force: exact where one list holds all, and by recall over many lists."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plotlink.llm import ann

ROWS = "vec_id long, embedding array<float>, label int, list int, block int, packed string, rank int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "p", 3) for i, v in rows], ROWS)


def taking_part(rows):
    out = set()
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            out.add((i, tuple(float(x) + 0.0 for x in v)))
    return out


def brute(rows, k=20, every=20):
    kept = taking_part(rows)
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in kept]
    want = defaultdict(list)
    for q, x in kept:
        if q is not None and q % every == 0:
            near = sorted(((-float(x @ y), i is None, i or 0) for i, y in kept if i != q), key=lambda r: r)[:k]
            want[q].append([(-s, None if none else i) for s, none, i in near])
    return want


def answers(df):
    got = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in got[r.query_id]
        got[r.query_id][r["rank"]] = (r.score, r.vec_id)
    return {q: [a[k] for k in sorted(a)] for q, a in got.items()}


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(-40, 260)]
    hot = [1.0, 2.0, 0.0, 1.0, -1.0, 3.0]
    rows += [(int(i), hot) for i in range(300, 480)]  # a third of all rows
    rows += [(500, None), (520, [0.0] * 6), (540, [1.0, None, 2.0, 3.0, 1.0, 1.0]), (560, [float("nan")] * 6), (580, [float("inf"), *[1.0] * 5]), (600, []), (620, [2.0, -0.0, 1.0]), (621, [3.0]), (None, [5.0] * 6), (None, hot)]
    return [*rows, (41, rows[80][1]), (300, hot)]


def test_exact_in_one_list(spark, small, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    got, want = answers(ann.nearest(make(spark, small))), brute(small)
    assert {q: [w] for q, w in got.items()} == dict(want)


def test_many_lists(spark, small):
    got, want = answers(ann.nearest(make(spark, small), target=1.0, list_size=16)), brute(small)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q][0])) for q in got)
    assert hits >= 0.95 * sum(len(w[0]) for w in want.values())


def test_recall_of_clusters_and_lengths(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 24))
    x = centers[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    x *= rng.uniform(0.5, 2.0, size=(3000, 1))  # the largest product is not the nearest direction
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    index = ann.Index(make(spark, rows), ann.F.col("vec_id") % 20 == 0, list_size=64)
    got, want = answers(index.search()), brute(rows)
    assert len(got) == 150 and all(len(g) == 20 for g in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q][0]}) / 20 for q in got])
    assert recall >= 0.93 and len(index.blocks) > 30
    truth = {q: dict((i, s) for s, i in brute(rows, k=3000)[q][0]) for q in list(got)[:5]}
    assert all(abs(truth[q][i] - s) < 1e-9 for q in truth for s, i in got[q])
    copies = index.postings.count() / index.size
    assert 1.0 < copies <= ann.REPLICAS


def test_graph_meets_what_lies_within_the_ratio():
    rng = np.random.default_rng(2)
    at = ann.balanced(rng.normal(size=(6000, 16)), 300)
    assert at.shape == (300, 16)
    graph, x = ann.Graph(at), rng.normal(size=(400, 16))
    met = graph.search(x, 1.1)
    d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
    assert np.allclose(met[np.isfinite(met)], d[np.isfinite(met)])
    within = d <= 1.21 * d.min(axis=1, keepdims=True)
    assert np.isfinite(met[within]).mean() > 0.99
    sizes = np.bincount(((rng.normal(size=(6000, 16))[:, None, :] - at[None, :50]) ** 2).sum(axis=2).argmin(axis=1))
    assert sizes.max() < 6000 / 4


def test_few_rows(spark):
    for rows in ([], [(20, None)], [(20, [1.0, 0.0])], [(0, [1.0, 0.0]), (20, [1.0, 0.0])], [(1, [1.0])]):
        assert {q: [w] for q, w in answers(ann.nearest(make(spark, rows))).items()} == {q: w for q, w in brute(rows).items() if w[0]}
