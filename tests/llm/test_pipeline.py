"""The corpus pipeline against its stages' rules by brute force."""

import collections
import re

import corpus_pipeline
from meshloom.llm import queries
from meshloom.llm.common import table

from .test_llm_operators import SF, check_packing, naive_fingerprint


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        old, new = {r.doc_id: r for r in before.collect()}, after.collect()
        if name != "packing":
            assert after.columns == docs.columns and {r.doc_id for r in new} <= set(old)
        if name == "language":
            assert len(new) >= 0.97 * len(old)
        if name == "near_dedup":
            fp = {i: naive_fingerprint(r.text) for i, r in old.items()}
            up = {i: i for i in old}

            def root(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a in old:
                for b in old:
                    if a < b and (fp[a] ^ fp[b]).bit_count() <= 3 and root(a) != root(b):
                        up[max(root(a), root(b))] = min(root(a), root(b))
            assert sorted(r.doc_id for r in new) == sorted({root(i) for i in old})
        if name == "secrets":
            assert len(new) == len(old)
            for r in new:
                assert not re.search(r"AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}", r.text)
                if "AKIA" not in old[r.doc_id].text and not re.search("token|password|secret|[A-Za-z0-9+/_-]{20}", old[r.doc_id].text):
                    assert r == old[r.doc_id]
        if name == "packing":
            check_packing(new, [(i, r.text) for i, r in old.items()])
        before = after
    whole = corpus_pipeline.run(spark, SF)
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, new))


def test_every_operator_has_its_query():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert all("LIMIT" not in s.upper() for s in queries.ORACLES.values())
