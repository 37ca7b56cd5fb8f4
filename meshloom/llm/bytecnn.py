"""Language identification by a byte convolutional network.

A text is lower-cased and its UTF-8 bytes are cut into windows of a fixed length that cover all of it.
Byte embeddings, filters of several widths, a maximum over each window and softmax give each window's
probabilities; a text's are their mean. The network is trained here, in numpy on the driver, on windows of a
bounded sample of labelled texts (``SAMPLE_DOCS`` a language, ``SAMPLE_WINDOWS`` a text) of every language there is (``LANGUAGES`` at most, or it is an error); it
is a few kilobytes, and is applied to every window of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import fold, map_slices

WINDOW, DIM, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, RATE, LANGUAGES, PIECES = 400, 6, 8, 0.01, 1000, 64
#: A letter, as the sample's filter in the JVM has it: numerals such as the fraction of a half are none.
LETTER = regex.compile(r"\p{L}")


class Net:
    """Embedding, one convolution that holds filters of all widths, maximum pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.langs, span, n = langs, max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((span, DIM, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(span * DIM, n)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": r.normal(0, 0.4, (span * DIM, n)).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.3, (n, len(langs))).astype(np.float32),
            "off": np.zeros(len(langs), np.float32),
        }

    def _unfold(self, w: np.ndarray) -> np.ndarray:
        e = self.p["emb"][w]
        span = max(WIDTHS)
        return np.concatenate([e[:, i : WINDOW - span + 1 + i] for i in range(span)], axis=2)

    def pooled(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pool(self._unfold(w))

    def _pool(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = (u.reshape(-1, u.shape[2]) @ self.p["conv"]).reshape(u.shape[0], u.shape[1], -1)
        return c, np.maximum(c.max(axis=1) + self.p["bias"], 0)

    def probabilities(self, windows: np.ndarray, step: int = 128) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)))
        for at in range(0, len(windows), step):
            _, h = self.pooled(windows[at : at + step])
            z = h @ self.p["out"] + self.p["off"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + step] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 12) -> None:
        """Adam on cross-entropy; only the window position that holds a filter's maximum gets its gradient."""
        r, span = np.random.default_rng(seed), max(WIDTHS)
        first, second, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for at in range(0, len(order), 64):
                w, label = windows[order[at : at + 64]], y[order[at : at + 64]]
                u = self._unfold(w)
                c, h = self._pool(u)
                where = c.argmax(axis=1)
                z = h @ self.p["out"] + self.p["off"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(label)), label] -= 1
                d /= len(label)
                g = {"out": h.T @ d, "off": d.sum(axis=0)}
                dh = (d @ self.p["out"].T) * (h > 0)
                g["bias"] = dh.sum(axis=0)
                picked = u[np.arange(len(w))[:, None], where]
                g["conv"] = np.einsum("bf,bfk->kf", dh, picked) * self.mask
                du = np.einsum("bf,kf->bfk", dh, self.p["conv"]).reshape(len(w), -1, span, DIM)
                g["emb"] = np.zeros_like(self.p["emb"])
                for i in range(span):
                    np.add.at(g["emb"], w[np.arange(len(w))[:, None], where + i], du[:, :, i])
                t += 1
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def cut_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and how many each text has; the last of a text is filled with zeros."""
    raw = [t.lower().encode() for t in texts]
    counts = np.array([-(-len(b) // WINDOW) for b in raw], np.int64)
    data = b"".join([b.ljust(int(n) * WINDOW, b"\0") for b, n in zip(raw, counts, strict=True)])
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), counts


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """A network trained on the rows where ``learn`` holds and lang isn't null; None if there are none. More than ``LANGUAGES`` languages are an error.

    The sample is, for each language, the ``SAMPLE_DOCS`` distinct rows (id and text) of least hash, so it depends neither on the order of rows nor on how ids or copies
    are spread: one id with a third of all rows gives as many texts as others, and copies of a row are one. A row's windows start at places drawn by its hash; where none of
    them has a letter, the one that starts at its first letter is taken.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("id", "text", F.lit(3)))
    # the least of each of PIECES pieces of a language and then of these, so that no task ranks more than PIECES x SAMPLE_DOCS rows of a language
    chosen = rows.select("lang", "hash").distinct().withColumn("piece", F.pmod("hash", F.lit(PIECES)))
    for by in (["lang", "piece"], ["lang"]):
        least = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
        chosen = chosen.withColumn("n", least).filter(F.col("n") <= SAMPLE_DOCS)
    # SAMPLE_DOCS x LANGUAGES rows at most
    chosen = chosen.select("lang", "hash").limit(SAMPLE_DOCS * LANGUAGES + 1)
    taken = rows.join(F.broadcast(chosen), ["lang", "hash"], "left_semi")
    start = lambda i: F.pmod(F.xxhash64("hash", i), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda i: F.substring(F.col("text"), start(i), F.lit(WINDOW)))
    first = F.substring(F.col("text"), F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(WINDOW))
    cut = taken.withColumn("w", F.filter(drawn, lambda w: w.rlike(r"\p{L}"))).withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(first)))
    sample = sorted((r["hash"], r["lang"], list(r["w"])) for r in cut.groupBy("lang", "hash").agg(F.min("w").alias("w")).collect())
    if not sample:
        return None
    langs = sorted({r[1] for r in sample})
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    windows, y = [], []
    for _, lang, texts in sample:
        for t in dict.fromkeys(texts):
            if LETTER.search(t):
                windows.append(t.lower().encode()[:WINDOW].ljust(WINDOW, b"\0"))
                y.append(langs.index(lang))
    net = Net(langs)
    net.train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(id, lang_pred, score, keep...[, text]) of each row from its whole text.

    ``und`` with score 0 where the text is null, empty or without any letter, or nothing could be learnt. Rows are
    independent of each other: repeated rows give repeated results.
    """
    kinds = dict(docs.dtypes)
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    schema = f"id {kinds[id_col]}, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in keep) + ", text string" * with_text

    def make():
        def f(b: pa.RecordBatch):
            texts = b["text"].to_pylist()
            known = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                windows, counts = cut_windows([texts[i] for i in known])
                p = np.add.reduceat(net.probabilities(windows), np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
                for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = net.langs[k], min(1.0, float(s))
            return pa.RecordBatch.from_arrays([b["id"], pa.array(lang), pa.array(score), *[b[c] for c in keep], *[b["text"]] * with_text], ["id", "lang_pred", "score", *keep, *["text"] * with_text])

        return f

    return map_slices(cols, "text", schema, make)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for ``documents``, learnt from those whose id's crc32 modulo 3 isn't 1: (doc_id, held_out, lang_pred, score).

    A null id counts as not held out, and isn't learnt from.
    """
    net = fit(docs, fold("id", 3) != 1)
    return predict(docs, net).select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, floor: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und``, and a score of ``floor`` or more. All columns are kept, whatever their names."""
    net = fit(docs, fold("id", 3) != 1)
    cols = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(cols)} | {"text": "text"}
    named = docs.toDF(*[at[c] for c in cols])
    out = predict(named, net, at["doc_id"], "text", tuple(at[c] for c in cols if c != "text"), with_text=True)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= floor)).select(*[F.col(at[c]).alias(c) for c in cols])
