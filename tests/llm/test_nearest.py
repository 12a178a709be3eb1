from datetime import datetime as T

import numpy as np
import pytest

from folioscope.llm import nearest


def frame(spark, x, keys=None):
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in zip(keys or [f"k{i:04d}" for i in range(len(x))], x)], "key string, embedding array<float>")


def test_estimates_stay_within_bounds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:50].mean(0)
    turn = nearest.rotation(128)
    assert np.allclose(turn @ turn.T, np.eye(128), atol=1e-5)
    bits, length, inner = nearest.codes((x - centre) @ turn.T)
    about, width = nearest.estimate(x[:100] @ turn.T, bits, length, inner)
    real = x[:100] @ (x - centre).T
    assert bits.shape == (400, 16) and (np.abs(about - real) <= width + 0.02).mean() > 0.9
    assert np.abs(about - real).mean() < 0.12


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MEMBER_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 128))
    x = np.concatenate([base + 0.3 * rng.standard_normal(base.shape) for _ in range(6)])
    keys = [f"k{i:04d}" for i in range(len(x))]
    got = {}
    for r in nearest.neighbours(frame(spark, x, keys)).collect():
        got.setdefault(r.key, {})[r.neighbour] = r.cosine
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len({keys[j] for j in np.argsort(-s[i])[:5]} & set(got[k])) for i, k in enumerate(keys))
    assert hits / (5 * len(keys)) >= 0.95 and all(len(v) == 5 for v in got.values())
    assert max(abs(c - s[int(a[1:]), int(b[1:])]) for a, v in got.items() for b, c in v.items()) < 1e-3


def test_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 128))
    x[1:9] = x[0]  # nine copies: more than anyone's neighbours
    got = {}
    for r in nearest.neighbours(frame(spark, x)).collect():
        got.setdefault(r.key, []).append((r.rank, r.neighbour))
    assert [n for _, n in sorted(got["k0000"])] == ["k0001", "k0002", "k0003", "k0004", "k0005"]
    assert [n for _, n in sorted(got["k0008"])] == ["k0000", "k0001", "k0002", "k0003", "k0004"]
    assert all(len(v) == 5 for v in got.values()) and len(got) == 12
    found = nearest.pairs(nearest.neighbours(frame(spark, x)), 0.85)
    assert found.count() == len({(min(a, b), max(a, b)) for a in range(9) for b in [z for z in range(9) if z != a][:5]})


def test_collection(spark):
    one = [1.0] + [0.0] * 127
    kind = "id string, embedding array<float>, metadata string, ts timestamp"
    vectors = [("a", one, None, T(2025, 1, 1)), ("a", None, None, T(2025, 2, 1)), ("b", one, None, T(2025, 1, 1)), ("b", one, None, T(2025, 1, 1)), ("c", [0.0] * 128, None, None), ("d", one[:64], None, None), ("e", [float("nan")] + one[1:], None, None), ("f", [float("inf")] + one[1:], None, None), ("g", [None] + one[1:], None, None), (None, one, None, None)]
    cache = [("p", None, None, one, "doc"), ("p", None, None, one, "doc"), ("q", None, None, None, "doc")]
    v = spark.createDataFrame(vectors, kind)
    c = spark.createDataFrame(cache, "path string, content_hash string, chunks array<string>, embedding array<float>, file_type string")
    rows = nearest.collection(v, c)
    assert rows.count() == 9
    got = nearest.neighbours(rows)
    assert sorted((r.key, r.neighbour) for r in got.collect()) == [("b", "p"), ("p", "b")]
    assert [tuple(r) for r in nearest.pairs(got, 0.85).collect()] == [("b", "p")]
    assert nearest.neighbours(rows.limit(0)).count() == 0
    assert nearest.neighbours(rows.where("key = 'b'")).count() == 0


@pytest.mark.parametrize("floor", [0.9, 2.0])
def test_floor(spark, floor):
    x = np.random.default_rng(5).standard_normal((40, 128))
    assert nearest.neighbours(frame(spark, x), floor=floor).count() == 0


def test_two_levels(spark, monkeypatch):
    """With few cells allowed on a level, there are two, and recall stays."""
    monkeypatch.setattr(nearest, "MOST_CELLS", 8)
    monkeypatch.setattr(nearest, "MEMBERS", 32)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 128))
    x = (centres[rng.integers(0, 40, 3000)] + 0.7 * rng.standard_normal((3000, 128))).astype(np.float32)
    x[:1000] = centres[0] + 0.3 * rng.standard_normal((1000, 128))  # a third of all in one place
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("bad", None)], "key string, embedding array<float>")
    got = {}
    for r in nearest.neighbours(df).collect():
        got.setdefault(int(r.key[1:]), []).append(int(r.neighbour[1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i].tolist())) / 5 for i in range(3000)]) >= 0.9
