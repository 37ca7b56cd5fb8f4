"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Distinct fingerprints are dealt into shards of about a thousand, and each shard is a BK-tree (children keyed by their integer Hamming
distance from the parent); a search follows only edges within the radius. Dealing is a router that loses no link: fingerprints that
differ in at most ``radius`` of 64 bits agree wholly on some ``blocks - radius`` of any ``blocks`` parts of the word, so each goes to a shard
for every such choice of parts, by as many of their bits as shards of that size need; few fingerprints are one tree. A shard over ``SHARD``
is split, and every pair of its pieces is searched, a tree of the one with the other's fingerprints: trees go to their queries in a shuffle and aren't
broadcast, as all of them grow with the corpus. Copies are folded before anything is shuffled. A kernel returns its links as stars (a member and the
least of its neighbours), never as all pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import map_slices, star, words
from meshloom.operators.graph import connected_components, dealt_join
from meshloom.plans.storage import materialize

BITS, SEED = 64, 42
MASK = (1 << BITS) - 1
#: Fingerprints in one BK-tree at most.
SHARD = 2048


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of the n-word shingles of a text: a bit is set if it is set in over half the shingles' XXH64."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(w) - n + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp long) for each row; a null text counts as empty, and its fingerprint is zero."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def f(b: pa.RecordBatch):
            fp = np.fromiter((fingerprint(t, n) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
            return pa.RecordBatch.from_arrays([b["id"], pa.array(fp.view(np.int64))], ["id", "fp"])

        return f

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", f"id {kind}, fp long", make)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class BKTree:
    """Burkhard-Keller tree over distinct integers under Hamming distance, in arrays. A node's children have different integer distances from it, which key them;
    all members below a child have that distance."""

    def __init__(self, members: np.ndarray):
        """The first member of a group is its node; the rest go on in a group for each distance. A level at a time."""
        n = len(members)
        parent, edge, value, rows = [], [], [], np.arange(n)
        group, base = np.zeros(n, np.int64), 0
        up = np.full(min(n, 1), -1, np.int64)  # of each group, the node above
        key = np.zeros(min(n, 1), np.int64)
        while len(rows):
            first = np.unique(group, return_index=True)[1]
            node = rows[first]
            value.append(members[node])
            parent.append(up)
            edge.append(key)
            rest = np.ones(len(rows), bool)
            rest[first] = False
            rows, group = rows[rest], group[rest]
            far = np.bitwise_count(members[rows] ^ members[node][group]).astype(np.int64)
            below, at = np.unique(group * 128 + far, return_inverse=True)
            order = np.argsort(at, kind="stable")
            rows, group = rows[order], at[order]
            up, key = below // 128 + base, below % 128
            base += len(node)
        self.value = np.concatenate(value) if value else np.empty(0, np.uint64)
        parent, edge = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parent, edge))
        # levels are laid out by parent and distance, so a node's children are neighbours in order of distance; ``upto``: how many are nearer than each distance
        has = parent >= 0
        many = np.bincount(parent[has], minlength=n)
        self.first = np.searchsorted(parent, np.arange(n))
        self.upto = np.zeros((n, BITS + 2), np.int32)
        np.add.at(self.upto, (parent[has], edge[has] + 1), 1)
        self.upto = np.cumsum(self.upto, axis=1, dtype=np.int32)
        self.leaf = many == 0

    def within(self, queries: np.ndarray, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all pairs at most ``radius`` bits apart: the distance to a node is compared, and only edges within the radius of it are followed."""
        found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        for at in range(0, len(queries) if len(self.value) else 0, step):
            block = queries[at : at + step]
            q, node = np.arange(len(block)), np.zeros(len(block), np.int64)
            while len(q):
                d = np.bitwise_count(block[q] ^ self.value[node]).astype(np.int64)
                hit = d <= radius
                found.append((q[hit] + at, self.value[node[hit]]))
                inner = ~self.leaf[node]
                q, node, d = q[inner], node[inner], d[inner]
                low = self.first[node] + self.upto[node, np.maximum(d - radius, 0)]
                many = self.first[node] + self.upto[node, np.minimum(d + radius, BITS) + 1] - low
                q, low = np.repeat(q, many), np.repeat(low - (np.cumsum(many) - many), many)
                node = low + np.arange(len(low))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shard_links(radius: int):
    """Kernel over rows (shard, part, fp, tree, query) that lie together by (shard, part): a tree of the one side, searched with the other; local stars."""

    def of_group(fp, tree, query):
        fp = fp.view(np.uint64)
        bk, asks = BKTree(fp[tree]), fp[query]
        q, member = bk.within(asks, radius)
        a, b = asks[q].view(np.int64), member.view(np.int64)
        return star(a[a != b], b[a != b])

    def run(batches):
        key, rows = None, []
        for b in batches:
            shard, part = b["shard"].to_numpy(), b["part"].to_numpy()
            cols = [b["fp"].to_numpy(), *(b[c].to_numpy(zero_copy_only=False) for c in ("tree", "query"))]
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if j == i:
                    continue
                if (shard[i], part[i]) != key:
                    yield from packed(rows)
                    key, rows = (shard[i], part[i]), []
                rows.append([c[i:j] for c in cols])
        yield from packed(rows)

    def packed(rows):
        if rows:
            a, b = of_group(*(np.concatenate(c) for c in zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def block_choice(n: int, radius: int = 3, each: int = SHARD // 2) -> int:
    """How many parts to cut 64 bits into, so that those that must agree have bits enough to deal n fingerprints into shards of about ``each``."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n >> (BITS * (blocks - radius) // blocks) > each:
        blocks += 1
    return blocks


def routes(n: int, radius: int, blocks: int, each: int) -> list[int]:
    """Masks of bits: two fingerprints within the radius agree on all bits of one mask at least. Each has bits for shards of about ``each`` of n fingerprints, and no more."""
    wanted = max(0, math.ceil(math.log2(max(n, 1) / each)))
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    out = []
    for kept in combinations(range(blocks), blocks - radius):
        mask, left = 0, wanted
        for k, i in enumerate(kept):
            bits = min(int(edges[i + 1] - edges[i]), -(-left // (len(kept) - k)))
            mask |= ((1 << bits) - 1) << int(edges[i])
            left -= bits
        out.append(mask)
    return list(dict.fromkeys(out))


def hamming_links(fps: DataFrame, radius: int = 3, shard: int = SHARD, blocks: int | None = None) -> DataFrame:
    """Stars (a, b) whose connected sets are those of all pairs of distinct ``fp`` within ``radius`` bits.

    ``fps``: one row for each distinct fingerprint (long). Null fingerprints aren't linked. ``blocks``: parts of the word, by ``block_choice`` if not given.
    """
    spark = fps.sparkSession
    fps = fps.filter("fp IS NOT NULL")
    n, each = fps.count(), max(1, shard // 2)
    masks = routes(n, radius, blocks or block_choice(n, radius, each), each)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for k, m in enumerate(masks)]
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    crowded = filed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / shard).cast("int").alias("s"))
    rows = dealt_join(filed, crowded, ["shard"], "fp").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int"))
    pieces = rows.select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    placed = pieces.select("shard", (low.cast("long") * (1 << 32) + high).alias("part"), "fp", (F.col("own") == low).alias("tree"), (F.col("own") == high).alias("query"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "fp").mapInArrow(_shard_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp long, component): the smallest id reachable over fingerprints within ``radius`` bits.

    Empty and null texts have fingerprint zero and are linked like others. Ties of fingerprints are one
    node, so repeated rows are kept as rows and share a component. A null id keeps its row; its component is the
    smallest id of its group, null if the group has none. An empty table gives an empty result.
    """
    named = materialize(fingerprints(docs, id_col, text_col, n), "simhash")
    distinct = named.groupBy("fp").agg(F.min("id").alias("least"))
    comp = connected_components(hamming_links(distinct.select("fp"), radius))
    of_fp = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = dealt_join(of_fp, smallest, ["component"], "fp").select("fp", "component_id")
    return dealt_join(named, by_fp, ["fp"], "id").select("id", "fp", F.col("component_id").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 3) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id, nulls last, and of these the least hash of all columns.

    Rows are told apart by id and hash, never by id alone, so a group without any id keeps a row as well, and so does each of two groups that share an id.
    Rows that are equal in all columns give one row.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, id_at = docs.toDF(*at.values()), at[id_col]
    digest = F.xxhash64(*rows.columns)
    row = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), digest.alias("digest"))
    groups = simhash_groups(rows.select(row.alias("row"), F.col(at[text_col]).alias("text")), "row", "text", n, radius)
    first = groups.filter(F.col("id") == F.col("component")).groupBy("id").agg(F.count("*").alias("copies"))
    first = materialize(first.select(F.col("id.id").alias("id"), F.col("id.digest").alias("row"), "copies"), "simhash-kept")
    # the way to join doesn't depend on how few rows there are
    keep = rows.withColumn("digest", digest).join(first.hint("shuffle_hash"), (F.col("digest") == F.col("row")) & F.col(id_at).eqNullSafe(F.col("id"))).drop("id", "row")
    if first.filter("copies > 1").limit(1).count():
        keep = keep.filter("copies = 1").unionByName(keep.filter("copies > 1").dropDuplicates([id_at, "digest"]))
    return keep.select(*[F.col(k).alias(c) for c, k in at.items()])
