"""Splitting labels: tiles from their cells' counts with batches taken out, and the order of levels."""

import numpy as np
import pytest

from meshloom.operators import analysis


def test_tiles_split_by_their_cells_counts(spark):
    """Two kinds of tiles that differ in genes; a batch adds counts of its own genes to half of each kind's cells; one tile has no counts."""
    r = np.random.default_rng(4)
    tiles, cells, counts, links = [], [], [], []
    for t in range(48):
        tiles.append((0, f"t{t}", "many"))
        for j in range(3):
            c = 3 * t + j
            cells.append((0, c, f"t{t}", f"b{c % 2}"))
            links += [(0, c, 3 * t + i) for i in range(3) if i != j]
            own = [g for g in range(12) if g % 2 == t % 2]
            counts += [(c, f"g{g}", float(r.poisson(9 if g in own else 1))) for g in range(12)]
            counts += [(c, f"h{g}", float(r.poisson(4 if c % 2 else 1))) for g in range(3)]
    tiles += [(0, "empty", "many"), (0, "other", "few")]
    cells.append((0, 900, "empty", "b0"))
    got = analysis.tile_subcluster_counts(
        spark.createDataFrame(tiles, "sample int, tile_id string, label string"), spark.createDataFrame(cells, "sample int, cell_id long, tile_id string, batch string"),
        spark.createDataFrame([c for c in counts if c[2] > 0], "cell_id long, gene string, count double"), spark.createDataFrame(links, "sample int, a long, b long"),
        "many", "label", genes=15, npcs=4, k=8, resolution=0.5, batches=("batch",),
    ).collect()
    label = {x.tile_id: x.label for x in got}
    assert len(got) == 50 and label["other"] == "few" and label["empty"] == "many_-1"
    even, odd = ({label[f"t{t}"] for t in range(k, 48, 2)} for k in (0, 1))
    assert even.isdisjoint(odd) and all(x.startswith("many_") for x in even | odd)


def test_levels_after_a_split():
    assert analysis.subcluster_levels(["a", "b", "c"], "b", [0, 1, 10]) == ["a", "b_0", "b_1", "b_10", "c"]
    assert analysis.subcluster_levels([1, 2], 2, []) == ["1"]
    with pytest.raises(ValueError, match="x"):
        analysis.subcluster_levels(["a"], "x", [1])
