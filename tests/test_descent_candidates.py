import numpy as np
import pyarrow as pa

from meshloom.operators import neighbours


def test_candidates_are_those_that_may_enter_a_list():
    """Of all pairs in a group with a new member, each member's best; none beyond the last of its list."""
    r = np.random.default_rng(5)
    sizes, k = [40, 1, 2, 25], 3
    groups = [[{"other": 100 * g + i, "new": int(r.random() < 0.5), "v": r.normal(size=4).tolist(), "last": float(r.choice([0.4, np.inf]))} for i in range(n)] for g, n in enumerate(sizes)]
    kind = pa.list_(pa.struct([("other", pa.int64()), ("new", pa.int32()), ("v", pa.list_(pa.float64())), ("last", pa.float64())]))
    found = {(x["id"], x["other"]): x["distance"] for b in neighbours._candidates(pa.array(groups, kind), k) for x in b.to_pylist()}
    want = {}
    for g in groups:
        for x in g:
            near = []
            for y in g:
                u, v = np.array(x["v"]), np.array(y["v"])
                d = 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v)
                if x is not y and (x["new"] or y["new"]) and d <= x["last"]:
                    near.append((d, y["other"]))
            want |= {(x["other"], o): d for d, o in sorted(near)[:k]}
    assert found.keys() == want.keys() and all(abs(found[p] - d) < 1e-9 for p, d in want.items())
