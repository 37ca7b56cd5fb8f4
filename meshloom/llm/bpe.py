"""BPE encoding and decoding with a public vocabulary, merged through segment trees.

A word's adjacent pairs are the leaves of a segment tree of minima. A leaf holds its pair's merge rank above
its position, so the root is the leftmost pair of lowest rank. Merging it changes two leaves, and
each change is carried up in a logarithmic number of steps until the root holds no pair. Distinct words of a batch run
in lockstep: trees of one size are rows of one array. Normalisation and the cut into words are the vocabulary's own.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import SPACE, map_slices

SPACES = re.compile(f"[{SPACE}]+")
CONTROLS = re.compile("[\x1c-\x1f]")
NONE = np.int64(1) << 62
POS = 24


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class MergeTable:
    """Rank and product of every mergeable pair of ids, by binary search in one sorted array."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        # the first of a repeated pair counts
        self.keys, first = np.unique(keys, return_index=True)
        self.rank = first.astype(np.int64)
        self.made = np.array([vocab[merges[i][0] + merges[i][1]] for i in first], np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where it can't be merged or an end is missing (negative)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), at, -1)


def merge_rows(ids: np.ndarray, table: MergeTable) -> np.ndarray:
    """Merge every row of ``ids`` (padded with -1 at the right; the width a power of two) until no pair is left; -1 marks what was merged away."""
    rows, width = ids.shape
    ids = ids.copy()
    nxt = np.tile(np.arange(1, width + 1), (rows, 1))
    prv = np.tile(np.arange(-1, width - 1), (rows, 1))
    lens = (ids >= 0).sum(axis=1)
    pair = np.full((rows, width), -1, np.int64)
    pair[:, :-1] = table.find(ids[:, :-1], ids[:, 1:])
    tree = np.full((rows, 2 * width), NONE, np.int64)
    tree[:, width:] = np.where(pair >= 0, table.rank[pair] << POS | np.arange(width), NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] < NONE)

    def put(r, pos, value):
        node = pos + width
        tree[r, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    while len(live):
        pos = tree[live, 1] & ((1 << POS) - 1)
        right = nxt[live, pos]
        after = nxt[live, right]
        ids[live, pos] = table.made[pair[live, pos]]
        ids[live, right] = -1
        nxt[live, pos] = after
        inner = after < lens[live]
        prv[live[inner], after[inner]] = pos[inner]
        put(live, right, NONE)
        for r, a, b in ((live[inner], pos[inner], after[inner]), (live[~inner], pos[~inner], None), (live[k := prv[live, pos] >= 0], prv[live, pos][k], pos[k])):
            if len(r):
                found = table.find(ids[r, a], ids[r, b]) if b is not None else np.full(len(r), -1)
                pair[r, a] = found
                put(r, a, np.where(found >= 0, table.rank[found] << POS | a, NONE))
        live = live[tree[live, 1] < NONE]
    return ids


class Coder:
    """Encoder and decoder for one vocabulary file of a BPE tokenizer; ``path`` is the file's place."""

    #: Words kept at most; beyond, all are forgotten, which only costs time.
    KEPT = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = MergeTable([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], vocab)
        self.lib = Tokenizer.from_file(path)
        self.vocab = vocab
        self.plain = self._plain_pattern(spec)
        self.token = {i: t for t, i in {**vocab, **self.special}.items()}
        self.joint = "" if spec.get("decoder") else " "
        self.seen: dict[str, bytes] = {}

    @staticmethod
    def _plain_pattern(spec: dict):
        """The vocabulary's own pattern for words, if on printable ASCII its steps come to lower case, that pattern and nothing else; otherwise None."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [n["type"] for n in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return None
        split, level = cuts
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def _learn(self, chunks: list[str]) -> None:
        normal = self.lib.normalizer.normalize_str if self.lib.normalizer else str
        cut = self.lib.pre_tokenizer.pre_tokenize_str
        made: dict[str, list[int] | None] = {}
        plain = self.plain
        split = [plain.findall(c.lower()) if plain and c.isascii() and c.isprintable() else [w for w, _ in cut(normal(c))] for c in chunks]
        by_width: dict[int, list[tuple[str, list[int]]]] = {}
        for w in {w for s in split for w in s}:
            ids = self._symbols(w)
            if len(ids) == 1:
                made[w] = ids
            else:
                by_width.setdefault(1 << (len(ids) - 1).bit_length(), []).append((w, ids))
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                rows = np.full((len(part), width), -1, np.int64)
                sizes = np.fromiter((len(ids) for _, ids in part), np.int64, len(part))
                rows[np.arange(width) < sizes[:, None]] = np.fromiter((i for _, ids in part for i in ids), np.int64, int(sizes.sum()))
                merged = merge_rows(rows, self.table)
                kept = merged >= 0
                flat, ends = merged[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
                for (w, _), a, b in zip(part, [0, *ends], ends, strict=False):
                    made[w] = flat[a:b]
        packed = {w: little(ids) for w, ids in made.items()}
        for c, s in zip(chunks, split, strict=True):
            self.seen[c] = packed[s[0]] if len(s) == 1 else b"".join([packed[w] for w in s])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        # str.split() also cuts at four control characters that aren't white space in Unicode
        return [c for c in SPACES.split(text) if c] if CONTROLS.search(text) else text.split()

    def _parts(self, text: str) -> list[str]:
        """Chunks and special tokens in order. Words never cross white space, so a chunk can be cut alone."""
        if not any(s in text for s in self.special):
            return self._chunks(text)
        parts, at = [], 0
        while at < len(text):
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                return parts + self._chunks(text[at:])
            i, _, s = min(found)
            parts += [*self._chunks(text[at:i]), s]
            at = i + len(s)
        return parts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts = [self._parts(t or "") for t in texts]
        seen = self.seen
        missing = list({c for p in parts for c in p if c not in seen})
        if len(seen) + len(missing) > self.KEPT:
            seen.clear()
            missing = list({c for p in parts for c in p})
        self._learn([c for c in missing if c not in self.special])
        for c in missing:
            if c in self.special:
                seen[c] = np.array([self.special[c]], "<u4").tobytes()
        return [b"".join([seen[c] for c in p]) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids as the vocabulary spells them; each must be one of its ids."""
        return self.joint.join(map(self.token.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row's whole text.

    A null or empty text has no tokens; its digests are those of no bytes. Rows are independent: repeated rows
    give repeated results, and a null id is kept. Very long words cost n log n.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * outputs

    def make():
        coder = shared_coder(path)

        def f(b: pa.RecordBatch):
            got = coder.encode_batch(b["text"].to_pylist())
            back = [coder.decode(np.frombuffer(x, "<u4").tolist()) for x in got]
            cols = [b["id"], pa.array([len(x) // 4 for x in got], pa.int64())]
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(y.encode()).hexdigest() for y in back], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in got], pa.list_(pa.int64())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names)

        return f

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", schema, make)


_coders: dict[str, Coder] = {}


def shared_coder(path: str) -> Coder:
    """One coder for each file in a worker process, which keeps what it has learnt for the next task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
