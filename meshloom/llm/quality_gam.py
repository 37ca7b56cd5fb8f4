"""A quality classifier: a generalised additive model with pairwise interactions.

Each text, read whole, gives a few numbers (shares of classes of characters, lengths and repetition of words and lines). Each feature is cut
into bins. Boosting goes round the features in turn: a shallow tree on one feature's bins, fitted to the present residuals, adds a small step to that
feature's lookup table; then the pairs of features that explain most of what is left get tables of their own in the same way. A score is the sum of
an intercept and one entry of each table, through the logistic function, so scoring is additions of looked-up values over whole batches.

The model is trained in numpy on the driver on a bounded sample of labelled rows (``SAMPLE``); everything else covers all rows.

Defined results: null and empty texts have features too (zeros) and a score; rows whose quality is neither 0 nor 1, and null ids, aren't learnt from; of several texts of
one labelled id the one of the least hash is learnt; an id with both labels is learnt with both; with no labels to learn from every score is 0.5, and with one class alone all scores are the same;
repeated rows have equal scores; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import fold, map_slices

#: Labelled rows learnt from at most, bins of a feature and of one side of a pair, pairs, boosting rounds of mains and pairs, step, least rows of a leaf.
SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST = 20_000, 32, 8, 6, 240, 80, 0.1, 8
THRESHOLD = 0.3

#: Classes of bytes: lower and upper case, digits, blanks, line ends, ends of sentences, exclamation, comma, bars, signs, brackets and quotes, other ASCII, the first byte of a longer character, its others.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "shout", "comma", "bar", "sign", "bracket", "other", "lead", "rest")
CLASS_OF = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t"), ("line", b"\r\n"), ("stop", b".?;:"), ("shout", b"!"), ("comma", b","), ("bar", b"|"),
    ("sign", b"#$%&*+=@^~\\/<>_"), ("bracket", b"()[]{}\"'`"), ("lead", range(192, 256)), ("rest", range(128, 192)),
):
    CLASS_OF[list(_bytes)] = CLASSES.index(_name)
SIGNS = np.array([c in ("sign", "shout", "bar") for c in CLASSES])
#: ``distinct_word_share`` is distinct words over words to the power 0.7, which hangs little on a text's length.
FEATURES = (
    "size", *[f"{c}_share" for c in CLASSES if c not in ("rest", "lower")], "word_length", "long_word_share", "distinct_word_share", "common_word_share", "sign_end_share", "capital_start_share",
    "shouted_share", "line_length", "distinct_line_share", "sentence_length", "doubled_share", "switch_share",
)


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, features). Characters are counted over all texts at once, words and lines by text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    kinds = CLASS_OF[data]
    at = np.concatenate([[0], np.cumsum(size)])
    some = np.maximum(size, 1)

    def share(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    of_class = np.array([np.bincount(kinds[a:b], minlength=len(CLASSES)) for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, len(CLASSES))
    counted = {c: of_class[:, i] for i, c in enumerate(CLASSES)}
    chars = np.maximum(size - counted["rest"], 1)
    gap = (kinds == CLASSES.index("blank")) | (kinds == CLASSES.index("line"))
    before = np.r_[True, gap[:-1]] if len(gap) else gap
    before[at[:-1][size > 0]] = True
    start = before & ~gap
    after = np.r_[gap[1:], True] if len(gap) else gap
    after[at[1:][size > 0] - 1] = True
    end = after & ~gap
    words = np.maximum(share(start), 1)
    upper = kinds == CLASSES.index("upper")
    same = np.r_[False, data[1:] == data[:-1]] if len(data) else gap.copy()
    switch = np.r_[False, kinds[1:] != kinds[:-1]] if len(data) else gap.copy()
    same[at[:-1][size > 0]] = switch[at[:-1][size > 0]] = False
    # runs from a word's start to its end, for lengths and words all in capitals
    firsts, lasts = np.flatnonzero(start), np.flatnonzero(end)
    length = lasts - firsts + 1
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (caps[lasts + 1] - caps[firsts]) * 2 > length
    of = np.searchsorted(at, firsts, side="right") - 1
    long_, loud = np.bincount(of, length > 14, len(texts)), np.bincount(of, shouted & (length > 1), len(texts))
    signs = SIGNS[kinds]
    rows = np.zeros((len(texts), 4))
    for i, b in enumerate(raw):
        if b:
            own, lines = b.split(), [line for line in b.splitlines() if line.strip()]
            seen: dict[bytes, int] = {}
            for w in own:
                seen[w] = seen.get(w, 0) + 1
            rows[i] = len(seen) / max(len(own), 1) ** 0.7, max(seen.values(), default=0) / max(len(own), 1), np.log1p(len(b) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1)
    cols = {"size": np.log1p(size), "word_length": (size - counted["blank"] - counted["line"]) / words, "long_word_share": long_ / words, "distinct_word_share": rows[:, 0], "common_word_share": rows[:, 1]}
    cols |= {f"{c}_share": counted[c] / chars for c in CLASSES} | {"sign_end_share": share(end & signs) / words, "capital_start_share": share(start & upper) / words, "shouted_share": loud / words}
    cols |= {"line_length": rows[:, 2], "distinct_line_share": rows[:, 3], "sentence_length": np.log1p(words / (counted["stop"] + counted["shout"] + 1)), "doubled_share": share(same) / some, "switch_share": share(switch) / some}
    return np.stack([cols[f] for f in FEATURES], axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins with gradients ``g``, curvatures ``h`` and counts ``n``; (0, 0) if none helps."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((nl >= LEAST) & (nr >= LEAST), gain, 0)
    i = int(gain.argmax()) if len(gain) else 0
    return (float(gain[i]), i + 1) if len(gain) and gain[i] > 0 else (0.0, 0)


def grown(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The steps of a shallow tree over the bins of one feature."""
    gain, i = best_cut(g, h, n) if depth else (0.0, 0)
    if not i:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([grown(g[:i], h[:i], n[:i], depth - 1), grown(g[i:], h[i:], n[i:], depth - 1)])


def grown_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree over the bins of two features that cuts one of them, and then each side along the other."""
    best, steps = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b, c = (g.T, h.T, n.T) if turned else (g, h, n)
        for i in range(1, len(a)):
            found, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + 1)
            for side in (slice(0, i), slice(i, len(a))):
                x, y, z = a[side].sum(axis=0), b[side].sum(axis=0), c[side].sum(axis=0)
                more, at = best_cut(x, y, z)
                gain += more + x.sum() ** 2 / (y.sum() + 1)
                found[side, :at] = x[:at].sum() / (y[:at].sum() + 1)
                found[side, at:] = x[at:].sum() / (y[at:].sum() + 1)
            if gain > best:
                best, steps = gain, found.T if turned else found
    return best, steps


class Model:
    """Cuts of each feature, its lookup table, and tables of pairs over coarser cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray | None = None, pairs: int = PAIRS):
        """Learn from rows ``x`` with labels ``y``; rows where ``hold`` is true (by default every fifth) only tell when to stop."""
        n, width = x.shape if len(x) else (0, len(FEATURES))
        self.cuts = [self._cuts(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
        self.coarse = [self._cuts(x[:, f], PAIR_BINS) if n else np.zeros(0) for f in range(width)]
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if n and 0 < y.sum() < n:
            hold = np.arange(n) % 5 == 4 if hold is None else hold
            self._boost(x, y.astype(float), ~hold, hold, pairs)

    @staticmethod
    def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(v, np.arange(1, bins) / bins))

    def _boost(self, x: np.ndarray, y: np.ndarray, learn: np.ndarray, hold: np.ndarray, pairs: int) -> None:
        bins = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)]
        coarse = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.coarse)]
        z = np.full(len(y), self.base)

        def loss() -> float:
            p = logistic(z[hold])
            return float(-np.mean(y[hold] * np.log(p + 1e-12) + (1 - y[hold]) * np.log(1 - p + 1e-12))) if hold.any() else 0.0

        def histogram(where: np.ndarray, size: int) -> list[np.ndarray]:
            p = logistic(z[learn])
            w = where[learn]
            return [np.bincount(w, v, size) for v in (y[learn] - p, p * (1 - p), None)]

        def cycle(terms: list, rounds: int) -> None:
            """Round after round over all terms (table, its bins, tree); the tables of the round with the least held loss stay."""
            nonlocal z
            best, since, kept, kept_z = loss(), 0, [t.copy() for t, _, _ in terms], z.copy()
            for i in range(rounds):
                for t, where, tree in terms:
                    step = RATE * tree(*(v.reshape(t.shape) for v in histogram(where, t.size)))
                    t += step
                    z = z + step.ravel()[where]
                now = loss()
                if now < best - 1e-7 or not hold.any():
                    best, kept, kept_z, since = now, [t.copy() for t, _, _ in terms], z.copy(), i
                elif i - since > 25:
                    break
            for (t, _, _), k in zip(terms, kept, strict=True):
                t[...] = k
            z = kept_z

        cycle([(t, b, grown) for t, b in zip(self.tables, bins, strict=True) if len(t) > 1], ROUNDS)
        found = []
        for a in range(len(bins)):
            for b in range(a):
                shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
                if min(shape) > 1:
                    where = coarse[a] * shape[1] + coarse[b]
                    gain, _ = grown_pair(*(v.reshape(shape) for v in histogram(where, shape[0] * shape[1])))
                    found.append((-gain, a, b, shape, where))
        found = sorted(found, key=lambda f: f[:3])[:pairs]
        self.pairs, self.pair_tables = [f[1:3] for f in found], [np.zeros(f[3]) for f in found]
        cycle([(t, f[4], lambda *h: grown_pair(*h)[1]) for t, f in zip(self.pair_tables, found, strict=True)], PAIR_ROUNDS)
        for t, b in zip(self.tables, bins, strict=True):  # tables about zero, what they share in the intercept
            shift = t[b].mean()
            t -= shift
            self.base += shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: one looked-up value of each table, added up for all rows at once."""
        z = np.full(len(x), self.base)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, f], side="left")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="left"), np.searchsorted(self.coarse[b], x[:, b], side="left")]
        return logistic(z)


def sample_of(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``sample`` labelled rows at most: the labelled ids of least hash, a text each. One id's rows, however many, are one row here."""
    taken = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(learn & F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    taken = taken.orderBy(F.xxhash64("id", "y", F.lit(5)), "id", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken.select("id").distinct()), "id", "left_semi")

    def make():
        def f(b: pa.RecordBatch):
            return pa.RecordBatch.from_arrays([b["id"], b["hash"], pa.array(features(b["text"].to_pylist()).tolist(), pa.list_(pa.float64()))], ["id", "hash", "x"])

        return f

    seen = map_slices(rows.select("id", "text", F.xxhash64("text").alias("hash")), "text", f"id {dict(rows.dtypes)['id']}, hash long, x array<double>", make)
    one = seen.groupBy("id").agg(F.min(F.struct("hash", "x")).alias("m")).select("id", F.col("m.x").alias("x"))
    found = one.join(F.broadcast(taken), "id").select("id", "y", "x").orderBy(F.xxhash64("id", "y", F.lit(6)), "id", "y").collect()  # ``sample`` rows at most
    return np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found], np.int64)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row from its whole text."""
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b["id"], pa.array(model.scores(features(b["text"].to_pylist())))], ["id", "score"])

    return map_slices(cols, "text", f"id {dict(docs.dtypes)[id_col]}, score double", make)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every document, learnt from labels of rows whose id's crc32 modulo 5 isn't 0. A null id isn't held out."""
    model = Model(*sample_of(docs, labels, fold("id", 5) != 0))
    return scored(docs, model).select("id", F.coalesce(fold("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
