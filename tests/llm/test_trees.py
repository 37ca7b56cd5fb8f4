"""BK-trees against all pairs, and the routes to them at every number of parts."""

import numpy as np
import pytest

from meshloom.llm import simhash
from meshloom.llm.common import Sets


def near(r, n):
    """Distinct fingerprints, many of them a few bits from another."""
    x = r.integers(0, 1 << 64, n // 2, dtype=np.uint64)
    y = x[r.integers(0, len(x), n // 2)]
    for _ in range(4):
        y = y ^ (np.uint64(1) << r.integers(0, 64, len(y)).astype(np.uint64)) * (r.random(len(y)) < 0.8).astype(np.uint64)
    return np.unique(np.concatenate([x, y]))


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_trees_find_all_pairs(radius):
    x = near(np.random.default_rng(radius), 1500)
    np.random.default_rng(9).shuffle(x)
    tree, asks = simhash.BKTree(x), x[::3]
    q, member = tree.within(asks, radius, step=100)
    a, b = np.nonzero(np.bitwise_count(asks[:, None] ^ x[None, :]) <= radius)
    assert sorted(zip(q.tolist(), member.tolist(), strict=True)) == sorted(zip(a.tolist(), x[b].tolist(), strict=True))


def test_children_are_keyed_by_distance():
    x = near(np.random.default_rng(1), 600)
    tree = simhash.BKTree(x)
    assert sorted(tree.value.tolist()) == sorted(x.tolist())
    for node in range(len(x)):
        many = int(tree.upto[node, -1])
        far = [int(tree.value[node] ^ tree.value[c]).bit_count() for c in range(tree.first[node], tree.first[node] + many)]
        assert far == sorted(set(far)) and [int(tree.upto[node, d + 1] - tree.upto[node, d]) for d in far] == [1] * many
    empty, one = simhash.BKTree(x[:0]), simhash.BKTree(x[:1])
    assert len(empty.within(x, 3)[0]) == 0 and one.within(x[:1], 0)[1].tolist() == [x[0]]


def test_a_search_leaves_most_edges():
    """On random fingerprints a search within 3 bits meets far fewer nodes than there are."""
    x = np.random.default_rng(3).integers(0, 1 << 64, 1024, dtype=np.uint64)
    tree, met = simhash.BKTree(x), []
    real = tree.value
    tree.value = type("Counted", (np.ndarray,), {"__getitem__": lambda self, i: (met.append(np.size(i)), np.ndarray.__getitem__(self, i))[1]})(real.shape, real.dtype, real.copy())
    tree.within(x[:64], 3)
    assert sum(met) < 0.6 * 64 * len(x)


@pytest.mark.parametrize("blocks", [4, 5, 6, 7, 8])
@pytest.mark.parametrize("shard", [16, 2048])
def test_links_at_any_number_of_parts(spark, blocks, shard):
    x = near(np.random.default_rng(blocks), 300)
    df = spark.createDataFrame([(simhash.signed(int(v)),) for v in x], "fp long")
    got, want = Sets(), Sets()
    for r in simhash.hamming_links(df, shard=shard, blocks=blocks).collect():
        got.join(r.a & simhash.MASK, r.b & simhash.MASK)
    for i, a in enumerate(x.tolist()):
        for b in x[:i].tolist():
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert {v: got.root(v) for v in x.tolist()} == {v: want.root(v) for v in x.tolist()}


def test_routes():
    """Pairs within the radius agree on a mask; few fingerprints need one route and no bits."""
    assert simhash.routes(500, 3, 4, 1024) == [0]
    r = np.random.default_rng(2)
    for blocks in (4, 5, 8):
        masks = simhash.routes(10**9, 3, blocks, 1024)
        for _ in range(200):
            flips = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(not flips & m for m in masks)
        assert all(m.bit_count() <= 20 for m in masks)
