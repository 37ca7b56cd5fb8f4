"""Lone near-duplicates between shards that hold nothing else alike."""

import numpy as np

from meshloom.llm import hnsw


def lone_pairs(n, pairs, d=64, seed=7):
    r = np.random.default_rng(seed)
    x, q = r.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q /= np.linalg.norm(q, axis=1)[:, None]
    a, b = r.permutation(n)[:pairs], r.permutation(n)[:pairs]
    away = r.normal(size=(pairs, d))
    away -= np.einsum("kd,kd->k", away, x[a])[:, None] * x[a]
    c = r.uniform(0.931, 0.96, (pairs, 1))
    q[b] = c * x[a] + np.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=1)[:, None]
    return x, q, set(zip(b.tolist(), a.tolist(), strict=True))


def links(x, q):
    return {(int(i), int(j)) for rows, nodes in hnsw.shard_links(x, q, hnsw.THRESHOLD) for i, j in zip(rows, nodes, strict=True)}


def test_lone_pairs_between_shards():
    x, q, want = lone_pairs(3000, 30)
    assert links(x, q) == want


def test_lone_pairs_in_a_shard():
    x, q, want = lone_pairs(1500, 15)
    both = np.concatenate([x, q])
    assert links(both, None) == {p for i, j in want for p in ((i + 1500, j), (j, i + 1500))}


def test_a_small_first_beam_is_widened(monkeypatch):
    """The first beam is a matter of speed: without any link among the audited queries it must still grow."""
    monkeypatch.setattr(hnsw, "BEAM", 2)
    x, q, want = lone_pairs(3000, 20)
    assert links(x, q) == want
