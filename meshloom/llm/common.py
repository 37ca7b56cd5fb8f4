"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from meshloom.plans.ship import ship

#: White_Space of Unicode, as the vocabularies' patterns see it, for a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Upper to lower case of A-Z alone, for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at ASCII white space only."""
    return text.encode().translate(LOWER).split() if text else []


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words`` of many texts at once: where those of each text begin (and the last end), and all of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end makes an empty word
    at = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return at[lists.offsets.to_numpy()], flat.filter(some).cast(pa.binary())


def in_slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (one row at least), so that memory stays bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), np.int64)
    cut = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_slices(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], limit: int = 8 << 20) -> DataFrame:
    """mapInArrow of ``make()(slice)`` over slices of bounded size."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in in_slices(batch, column, limit):
                yield f(part)

    return df.mapInArrow(run, schema)


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block of links as stars about each query's least node: as many rows as queries and nodes, with the same connected sets."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    hub = b[first][np.cumsum(first) - 1] if len(a) else b
    return tuple(np.unique(np.stack([np.r_[a, b], np.r_[hub, hub]]), axis=1))


class Sets:
    """Union-find over arbitrary hashable nodes; the smallest member is the root."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
