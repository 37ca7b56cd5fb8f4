"""Compression of vectors to product codes with integer codebooks.

Components become whole numbers and a vector is cut into equal parts; each part is coded by the nearest entry of its position's codebook. The codebooks
(parts x entries rows, whatever the corpus) go to every task; a task takes Arrow batches and works out all distances to the entries of a part at
once, |x|^2 - 2xc + |c|^2 with exact integer products, and takes the first least one. Its sums and counts by entry are merged by a grouped
aggregate in each round.

Defined results: vectors that are null or hold null or non-finite components are dropped, as are those of no component and those of another length than most
have (of lengths equally frequent, the greater stays); a length that the parts don't divide is filled up with zeros. Scaled components beyond 2^27 count as
2^27. First entries are the smallest ids, null ids last, ties by vector; with fewer vectors than entries the codebooks are smaller. Repeated rows are rows
each. An empty table gives an empty result. Sums beyond a long are given as the greatest long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.integers import add_rows, as_long, digest, finite, floors, nearest
from meshloom.llm.vectors import matrix
from meshloom.operators.graph import dealt_join
from meshloom.plans.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def cut(column: pa.ChunkedArray, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, width): scaled vectors in equal parts."""
    x = floors(matrix(column), scale)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return x.reshape(len(x), parts, x.shape[1] // parts)


def learn(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks of the next round: exact floors of the means of the parts that an entry codes; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = cut(pa.chunked_array([batch["v"]]), parts, scale)
                for p in range(parts):
                    add_rows(total, count, p * entries + nearest(x[:, p], books[p])[0], x[:, p])
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["entry", "n", "total"])

    added = rows.select("v").mapInArrow(run, "entry int, n long, total array<long>").groupBy("entry")
    out = books.reshape(parts * entries, width).copy()
    for row in added.agg(F.sum("n"), *[F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(width)]).collect():  # a row an entry at most
        out[row[0]] = [int(s) // row[1] for s in row[2:]]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part; see the module. ``entries`` is 256 at most, as a code has two hex digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("entries is 1 to 256")
    kind = dict(vectors.dtypes)[id_col]
    # labels as text, so that nulls are equal too
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label")
    whole = vectors.select(F.col(id_col).alias("id"), label, F.col(vec_col).cast("array<double>").alias("v")).filter(finite("v") & (F.size("v") > 0))
    most = whole.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = whole.filter(F.size("v") == (most["dims"] if most else 0))
    start = rows.select("v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # the first entries alone
    width = -(-most["dims"] // parts) if most else 0
    if start:
        books = np.ascontiguousarray(cut(pa.chunked_array([pa.array([r["v"] for r in start], pa.list_(pa.float64()))]), parts, scale).transpose(1, 0, 2))
    else:
        books = np.zeros((parts, 0, width), np.int64)
    for _ in range(rounds if start else 0):
        books = learn(rows, books, scale)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = cut(pa.chunked_array([batch["v"]]), parts, scale)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([row.tobytes().hex() for row in code]), pa.array(sum(f[1] for f in found))], ["id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(run, f"id {kind}, label string, code string, error long"), "codes").withColumn("row", F.monotonically_increasing_id())
    of_label = coded.groupBy("label").agg(as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    # a label that a third of the rows have is dealt to many tasks
    return dealt_join(coded, of_label, ["label"], "row").select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
