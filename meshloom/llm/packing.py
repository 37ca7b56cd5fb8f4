"""Packing of documents into fixed-length sequences by cutting-stock column generation.

Whole runs of ``capacity`` tokens fill sequences of their own; what is left of each document is an item, cut once
more at half the capacity if it is longer, so that items are small enough to fill sequences without waste. The
histogram of item lengths (at most ``capacity`` numbers, whatever the data) goes to the driver, where a linear
program over patterns is solved: the dual prices of the lengths enter a knapsack dynamic program, whose best
filling is the next column, until no column helps or the bound is close. Rounded-down patterns are repeated, the
rest is filled by best fit. The plan is a small table of rank ranges by length; an item's rank within
its length says which copy of which pattern takes it, and where. Ranks come from counts by (length, salt), so that no
length has to be in one task.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import map_slices
from meshloom.plans.storage import materialize

CAPACITY, END = 1024, 0
#: Relative distance from the bound at which column generation stops, and most columns.
GAP, ROUNDS = 0.001, 4000


#: How the vocabulary's words are cut; a fixed value of its public definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of a byte-level BPE vocabulary file as the tokenizers library gives them.

    Where its ids are the ranks of its merges, tiktoken encodes with the same table, several times as fast. Texts that spell a special
    token, and vocabularies of another order, go through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = len(vocab) == 256 + len(merges) and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()} if in_order else None
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def _by_lib(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        slow = [i for i, t in enumerate(texts) if t and (self.fast is None or any(s in t for s in self.special))]
        out = dict(zip(slow, self._by_lib([texts[i] for i in slow]), strict=True))
        return [out[i] if i in out else self.fast.encode_to_numpy(t).astype("<u4").tobytes() if t else b"" for i, t in enumerate(texts)]


_tokens: dict[str, Tokens] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at every ``capacity``, and a rest over half of it at half."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        coder, end = _tokens[path], np.array([END], "<u4").tobytes()
        half = capacity // 2

        def f(b: pa.RecordBatch):
            ids = [x + end for x in coder.encode_batch(b["text"].to_pylist())]
            take, rows = [], []
            for i, x in enumerate(ids):
                n = len(x) // 4
                ends = list(range(capacity, n + 1, capacity))
                if n - (last := n // capacity * capacity) > half:
                    ends.append(last + half)
                for s, e in zip([0, *ends], [*ends, n] if not ends or ends[-1] < n else ends, strict=False):
                    part = x[4 * s : 4 * e]
                    take.append(i)
                    rows.append((s, len(part) // 4, zlib.crc32(part), n))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([b["id"].take(pa.array(take, pa.int64())), *cols], ["id", "start", "length", "ids_crc32", "doc_tokens"])

        return f

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long", make)


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling: its value and how often each size is taken. Dynamic program over capacities."""
    best, by_size = np.zeros(capacity + 1), np.full(capacity + 1, -np.inf)
    by_size[sizes] = value
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = by_size[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(total.argmax())
        if total[k] > best[c - 1] + 1e-12:
            best[c], took[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c, index = np.zeros(len(sizes), np.int64), capacity, {int(s): i for i, s in enumerate(sizes)}
    while c > 0:
        if took[c]:
            counts[index[int(took[c])]] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns (columns) and how often each is used in the linear program's solution; revised simplex."""
    m = len(sizes)
    per = capacity // sizes
    basis = np.diag(per).astype(float)
    inverse = np.diag(1.0 / per)
    x = demand / per
    material = float((sizes * demand).sum()) / capacity
    bound = material
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        total = x.sum()
        worth, column = knapsack(np.maximum(y, 0), sizes, capacity)
        bound = max(bound, total / worth)
        if worth <= 1 + 1e-9 or total <= bound * (1 + gap):
            break
        column = column.astype(float)
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / direction[up]
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
    return basis, x


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that still takes it; bins are filed by their room."""
    rooms: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for size in sorted(items, reverse=True):
        room = next((r for r in range(size, capacity) if rooms.get(r)), None)
        if room is None:
            room, one = capacity, []
            bins.append(one)
        else:
            one = rooms[room].pop()
        one.append(size)
        rooms.setdefault(room - size, []).append(one)
    return bins


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: copies}, times)] that takes every item exactly once."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    basis, x = solve_patterns(sizes, demand.astype(float), capacity, gap, rounds)
    out: dict[tuple, int] = {}
    left = demand.copy()
    for j in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times > 0:
            key = tuple((int(s), int(a)) for s, a in zip(sizes[used], pattern[used], strict=True))
            out[key] = out.get(key, 0) + times
            left -= times * pattern
    for one in best_fit([int(s) for s, n in zip(sizes, left, strict=True) for _ in range(n)], capacity):
        key = tuple((s, one.count(s)) for s in sorted(set(one)))
        out[key] = out.get(key, 0) + 1
    return [(dict(k), n) for k, n in out.items()]


def plan_rows(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, copies, first sequence, first offset): which ranks of a length a pattern takes, and where."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            a, lo = pattern[size], taken.get(size, 0)
            rows.append((size, lo, lo + a * times, a, sequence, offset))
            taken[size] = lo + a * times
            offset += a * size
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", gap: float = GAP, rounds: int = ROUNDS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each piece of each document and its place.

    A null or empty text is the end id alone. Repeated rows and null ids are documents like others: each is packed. An
    empty table gives an empty result. Offsets of a sequence run without gaps from 0. The driver only sees the histogram of
    lengths; the plan it returns has at most a few rows for each of ``capacity`` lengths and is broadcast.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, id_col, text_col), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_rows(plan_patterns(histogram, capacity, gap, rounds))
    fields = ["length", "lo", "hi", "copies", "sequence", "first"]
    listed = F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";")
    plan = spark.range(1).select(F.explode(listed).alias("r")).filter("r <> ''").select(F.split("r", ",").alias("r")).select(*[F.col("r")[i].cast("long").alias(c) for i, c in enumerate(fields)])
    salts = max(16, sum(histogram.values()) // 50_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "length").filter("rank >= lo AND rank < hi")
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("sequence") + F.floor(nth / F.col("copies")).cast("long")
    offset = F.col("first") + (nth % F.col("copies")) * F.col("length")
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
