"""Exact neighbours by brute force where products tie, where norms differ by many orders, and where a shard is one leaf."""

import numpy as np
import pytest

from docrecon.llm import vectors


def brute(ids, w):
    out = []
    for q in np.flatnonzero(ids % vectors.EVERY == 0):
        s = (w[q] * w).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][: vectors.NEAREST]
        out += [(int(ids[q]), k + 1, int(ids[i]), float(s[i])) for k, i in enumerate(order)]
    return sorted(out)


def found(spark, ids, w, factor):
    frame = spark.createDataFrame(list(zip(ids.tolist(), w.tolist(), strict=True)), "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in vectors.nearest(frame, factor=factor).select("query_id", "rank", "vec_id", "score").collect())


def table(kind, n=1200):
    rng = np.random.default_rng(9)
    ids = rng.permutation(3 * n)[:n].astype(np.int64)
    if kind == "ties":  # distinct vectors of few products
        w = rng.integers(-2, 3, (n, 6)).astype(float)
        w = w[w.any(axis=1)]
        return ids[: len(w)], w
    w = rng.normal(size=(n, 6))
    if kind == "norms":
        w *= 10.0 ** rng.uniform(-3, 10, (n, 1))
    elif kind == "one long":
        w[7] *= 4e10
    elif kind == "huge":
        w *= 10.0 ** rng.choice([-150, 0, 100], (n, 1))
    elif kind == "equal":
        w[: n // 2] = w[0]
    return ids, w


@pytest.mark.parametrize("kind", ["ties", "norms", "one long", "huge", "equal", "plain"])
def test_exact_at_factor_one(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 300 * 6 * 8)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 20 * 6 * 8)
    monkeypatch.setattr(vectors, "TASK_BLOCKS", 2)
    monkeypatch.setattr(vectors, "LEAF", 16)
    ids, w = table(kind)
    assert found(spark, ids, w, 1.0) == brute(ids, w)


@pytest.mark.parametrize("kind", ["norms", "one long", "ties"])
def test_recall_with_measured_factors(spark, kind):
    ids, w = table(kind, 4000)
    want, got = brute(ids, w), found(spark, ids, w, None)
    least = {(q, r): s for q, r, _, s in want}
    hits = sum(s >= least[q, vectors.NEAREST] for q, _, _, s in got)
    assert len(got) == len(want) and hits >= 0.9 * len(want)
