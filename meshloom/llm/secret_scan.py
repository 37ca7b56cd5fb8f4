"""Secret scans: candidates by pattern, false positives removed by a random forest, all in JVM expressions.

One regular expression finds candidates in a text, which is cut at their places. For each, features are computed from the value and its
surroundings: length, transitions between classes of characters, coverage by dictionary words, signs of a path and
neighbouring words. A random forest trained on labelled findings gives the share of trees that take it for a secret.
The findings are generated (real secrets mustn't be shipped): patterns of live credentials against digests, ids,
placeholders, paths and long words in their usual surroundings. The forest is grown on the driver from at most
``FINDINGS`` rows, and becomes one SQL expression, so executors run no Python.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS, TREES, DEPTH, KEEP, HIDDEN = 2400, 15, 6, 0.5, "[REDACTED]"
NAMES = "password|passwd|passphrase|pass(?![a-zA-Z])|pwd|auth(?![a-zA-Z])|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credential"
NAMED = rf"(?:{NAMES})[\w-]{{0,40}}[\"']?\s*+(?::=|=>|[:=])\s*+"
ASSIGNED = NAMED + r"[\"']?"
#: A value in quotes, up to the same quote on its line; a backslash takes the character after it along.
WITHIN = "|".join(rf"{q}(?=(?:\\[^\r\n]|[^{q}\\\r\n]){{4}})[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+)*+(?={q})" for q in "\"'")
#: Candidates, first match first: assigned values, whatever stands before the name; known prefixes, key blocks, passwords in addresses, long mixed tokens.
#: Values have no upper length, so that none is cut to a part of itself; a run of one class of characters is linear. Any number of blanks may stand around the sign.
PATTERN = (
    rf"(?=[acpstACPST])(?i:{NAMED})(?:{WITHIN}|[\"']?[^\s\"'<>,;]{{4,}}+)"
    r"|(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}+\b|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35,}+|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+\b"
    r"|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2,4}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?<=://)[^\s/:@]++:[^\s/@]{3,}+(?=@)"
    r"|(?<![+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2})"
)
#: Words that speak of ordinary values.
WORDS = "about account admin alpha article base beta build cache center change changeme class client code config content copy data date debug default demo description document dummy example false file folder group hello home image index input install item label layout letmein level library list local login main message model module name none null number object option order output package page path placeholder project public qwerty query record release report request resource response root sample script server service session setting source static status string style system table target template test text this title true type update upload user value version video view welcome width window world your".split()
VALUE = r"(?<=\()value(?=[,)])"
FEATURES = ("len", "turns", "turn_rate", "digit_share", "upper_share", "hex", "covered", "vowel_share", "path", "prefix", "named", "near_secret", "near_digest", "near_example", "distinct_share", "dashes")


def quoted(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_exprs(raw: str, before: str, after: str) -> dict[str, str]:
    """SQL of each feature, from SQL for the candidate and the text on either side."""
    v, size = "value", "greatest(length(value), 1)"
    only = lambda kept: f"double(length(regexp_replace({v}, {quoted(kept)}, ''))) / {size}"
    has = lambda where, pattern: f"double({where} rlike {quoted(pattern)})"
    runs = v
    for pattern, sign in (("[^A-Za-z0-9]+", "-"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = f"regexp_replace({runs}, '{pattern}', '{sign}')"
    longest_first = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    side = f"lower(concat(right({before}, 40), ' ', left({after}, 20)))"
    return {
        "value": f"regexp_replace({raw}, {quoted(f'^(?i:{ASSIGNED})')}, '')",
        "len": f"double(least(length({v}), 128))",
        "turns": f"double(least(length({runs}) - 1, 64))",
        "turn_rate": f"double(length({runs}) - 1) / {size}",
        "digit_share": only("[^0-9]"),
        "upper_share": only("[^A-Z]"),
        "hex": has(f"({v})", "^[0-9a-fA-F]+$"),
        "covered": f"1 - {only(f'(?i:{longest_first})')}",
        "vowel_share": only("[^aeiouAEIOU]"),
        "path": f"greatest({has(f'({v})', r'(?:^|[/.])[a-z_-]{2,}/[a-z_-]{2,}|[.][a-z]{2,4}$')}, {has(before, r'(?:https?://|/)[^ ]*$')})",
        "prefix": has(f"({v})", r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|AIza|[sr]k_live_|eyJ|-----BEGIN)"),
        "named": f"double(length({v}) < length({raw}))",
        "near_secret": has(side, f"(?:{NAMES}|bearer|authorization)"),
        "near_digest": has(side, "(?:commit|sha-?[0-9]|md5|checksum|digest|hash|etag|uuid|guid|revision|build|integrity|fingerprint)"),
        "near_example": has(f"concat({side}, lower({v}))", r"(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test_|[*]{3}|<|[$][{(]|env)"),
        "distinct_share": f"double(size(array_distinct(split({v}, '')))) / {size}",
        "dashes": has(f"({v})", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
    }


def generated_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, int]]:
    """(text around one candidate, 1 for a secret). Balanced, and the same for one seed."""
    r = np.random.default_rng(seed)
    pick = lambda a: a[int(r.integers(len(a)))]
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mix = "0123456789abcdef", low + up + dig
    prose = lambda: " ".join(some(low, int(r.integers(2, 9))) for _ in range(int(r.integers(2, 7))))
    name = lambda: pick("password passwd pwd secret token api_key access_key client_secret auth_key apikey db_pass auth".split())
    sign = lambda: pick(["=", " = ", ": ", ":", ' = "', '="', "='"])
    shut = lambda s: '"' if '"' in s else "'" if "'" in s else ""

    def put(value):
        s = sign()
        return name() + s + value + shut(s)

    def secret():
        k = int(r.integers(10))
        if k == 9:  # a passphrase, or signs of all kinds, in quotes
            q = pick("\"'")
            words = pick([" ", ", ", "-"]).join(some(low, int(r.integers(3, 9))) for _ in range(int(r.integers(3, 6))))
            return name() + pick(["=", " = ", ": ", ":    "]) + q + pick([words + pick(["", " "]) + some(dig, int(r.integers(1, 4))), some(mix + "<>,;!$%", int(r.integers(10, 24)))]) + q
        if k == 0:
            return pick(["AKIA", "ASIA"]) + some(up + dig, 16)
        if k <= 3:
            return put(some(hexa, int(pick([16, 18, 20, 24, 32, 40, 48, 64]))))
        if k == 4:
            return put(some(mix + "!#%&*+-_", int(r.integers(8, 40))))
        if k == 5:
            return "gh" + pick("pousr") + "_" + some(mix, 36)
        if k == 6:
            return pick([f"xoxb-{some(dig, 12)}-{some(mix, 24)}", "AIza" + some(mix + "_-", 35), "sk_live_" + some(mix, 24), f"eyJ{some(mix, 17)}.eyJ{some(mix, 40)}.{some(mix + '_-', 43)}", "-----BEGIN RSA PRIVATE KEY-----"])
        if k == 7:
            return pick(["bearer ", "authorization ", "secret key "]) + some(mix + "+/", int(r.integers(24, 64)))
        return f"{pick(['https', 'postgres', 'redis'])}://{some(low, 6)}:{some(mix, int(r.integers(8, 20)))}@{some(low, 8)}.net"

    def innocent():
        k = int(r.integers(10))
        if k == 9:  # plain words in quotes
            q = pick("\"'")
            return name() + pick(["=", " = ", ": ", ":    "]) + q + pick([" ", ", "]).join(pick(WORDS) for _ in range(int(r.integers(2, 6)))) + q
        if k == 0:
            return pick(["commit ", "sha1 ", "sha256 ", "md5 ", "checksum ", "hash ", "etag "]) + some(hexa, int(pick([32, 40, 64])))
        if k == 1:
            return pick(["id ", "uuid ", "request ", ""]) + "-".join(some(hexa, m) for m in (8, 4, 4, 4, 12))
        if k <= 3:
            return put(pick(["changeme", "example", "your_password", "your-token-here", "placeholder", "xxxxxxxxxxxx", "${TOKEN}", "os.environ", "null", "none", "test_password", "********", "required", "string", "default_value", "password", "hello_world"]))
        if k == 4:
            return "/" + "/".join(pick(WORDS) for _ in range(int(r.integers(3, 6)))) + "/" + pick(WORDS) + dig[int(r.integers(10))] + pick([".html", "", ".png"])
        if k == 5:
            return "https://" + some(low, 6) + ".org/" + "/".join(pick(WORDS) + pick(["", "1", "2"]) for _ in range(4))
        if k == 6:
            return "".join(pick(WORDS).capitalize() for _ in range(4)) + str(int(r.integers(1, 99)))
        if k == 7:
            return "_".join(pick(WORDS) for _ in range(4)) + "_" + str(int(r.integers(1, 2030)))
        return "-".join([some(low, int(r.integers(3, 9))) for _ in range(4)] + [str(int(r.integers(1, 2030)))])

    return [(f"{prose()} {secret() if i % 2 else innocent()} {prose()}", i % 2) for i in range(n)]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__parts``: the text cut at candidates, which have the odd positions; null for a null text. Every character of the text is in one part, as it is."""
    cut, hits = F.split(text_col, PATTERN, -1), F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0))
    out = docs.withColumn("__cut", cut).withColumn("__hits", hits)
    parts = F.expr("flatten(transform(__cut, (p, i) -> case when i < size(__hits) then array(p, get(__hits, i)) else array(p) end))")
    return out.withColumn("__parts", parts).drop("__cut", "__hits")


#: Parts whose lengths are added up together, so that places in a text of many candidates don't take the square of their number.
TOGETHER = 256


def with_features(cut: DataFrame) -> DataFrame:
    """``__found``: for each candidate its place in the text (code points), value and features."""
    e = feature_exprs("c.raw", "c.before", "c.after")
    out = cut.withColumn("__n", F.expr("transform(__parts, p -> length(p))"))
    out = out.withColumn("__sums", F.expr(f"transform(sequence(0, greatest(size(__n) - 1, 0), {TOGETHER}), b -> aggregate(slice(__n, b + 1, {TOGETHER}), 0L, (a, n) -> a + n))"))
    start = f"aggregate(slice(__sums, 1, i div {TOGETHER}), 0L, (a, n) -> a + n) + aggregate(slice(__n, int(i - i % {TOGETHER}) + 1, i % {TOGETHER}), 0L, (a, n) -> a + n)"
    places = f"transform(sequence(1, greatest(size(__parts) - 1, 1), 2), i -> named_struct('raw', coalesce(get(__parts, i), ''), 'before', coalesce(get(__parts, i - 1), ''), 'after', coalesce(get(__parts, i + 1), ''), 'start', {start}))"
    out = out.withColumn("__c", F.expr(f"case when size(__parts) > 2 then {places} else array() end"))
    value = f"transform(__c, c -> named_struct('raw', c.raw, 'before', right(c.before, 80), 'after', left(c.after, 40), 'value', {e['value']}, 'start', bigint(c.start + length(c.raw) - length({e['value']}))))"
    out = out.withColumn("__c", F.expr(value))
    # the field, not the word in a pattern
    inner = ", ".join(f"'{k}', {re.sub(VALUE, 'c.value', e[k])}" for k in FEATURES)
    return out.withColumn("__found", F.expr(f"transform(__c, c -> named_struct('raw', c.raw, 'value', c.value, 'start', c.start, {inner}))")).drop("__c", "__n", "__sums")


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 9) -> list:
    """A random forest: trees as nested (feature, threshold, left, right) or a leaf's share of secrets."""
    r = np.random.default_rng(seed)

    def node(rows, level):
        share = float(y[rows].mean())
        if level == 0 or len(rows) < 8 or share in (0.0, 1.0):
            return round(share, 6)
        best = None
        for f in r.choice(x.shape[1], max(1, int(np.ceil(np.sqrt(x.shape[1])))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[:-1] < v[1:]) + 1
            if len(cut):
                n, left = len(rows), hits[cut - 1]
                p, q = left / cut, (hits[-1] - left) / (n - cut)
                loss = cut * p * (1 - p) + (n - cut) * q * (1 - q)
                i = int(loss.argmin())
                if best is None or loss[i] < best[0]:
                    best = (loss[i], int(f), float((v[cut[i] - 1] + v[cut[i]]) / 2), order[: cut[i]], order[cut[i] :])
        if best is None:
            return round(share, 6)
        return best[1], round(best[2], 6), node(best[3], level - 1), node(best[4], level - 1)

    return [node(r.integers(0, len(x), len(x)), depth) for _ in range(trees)]


def forest_sql(forest: list, name: str = "f") -> str:
    """The forest's mean as one SQL expression over the fields of ``name``."""

    def sql(t):
        return f"{t}D" if isinstance(t, float) else f"case when {name}.{FEATURES[t[0]]} <= {t[1]}D then {sql(t[2])} else {sql(t[3])} end"

    return f"({' + '.join(sql(t) for t in forest)}) / {len(forest)}D"


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None) -> list:
    """Forest from labelled findings [(text around a candidate, 0 or 1)]; by default the generated ones. Texts without a candidate are left out."""
    rows = generated_findings() if findings is None else findings[:FINDINGS]
    listed = F.explode(F.from_json(F.lit(json.dumps([{"text": t, "y": y} for t, y in rows])), "array<struct<text:string,y:int>>"))
    found = with_features(candidates(spark.range(1).select(listed.alias("r")).select("r.*"))).filter("size(__found) > 0")
    got = found.select("y", *[F.col("__found")[0][k].alias(k) for k in FEATURES]).collect()
    return grow(np.array([[r[k] for k in FEATURES] for r in got], float), np.array([r["y"] for r in got], float))


def scored(docs: DataFrame, forest: list | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__parts`` and ``__scored``: array of (start, raw, value, score, secret), one for each candidate."""
    forest = train(docs.sparkSession) if forest is None else forest
    out = with_features(candidates(docs, text_col))
    out = out.withColumn("__scored", F.expr(f"transform(__found, f -> named_struct('start', f.start, 'raw', f.raw, 'value', f.value, 'score', {forest_sql(forest)}))")).drop("__found")
    return out.withColumn("__scored", F.expr(f"transform(__scored, f -> named_struct('start', f.start, 'raw', f.raw, 'value', f.value, 'score', f.score, 'secret', f.score >= {KEEP}D))"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: list | None = None) -> DataFrame:
    """Every candidate of every row: (id, start, n_chars, value_sha256, score, secret).

    ``start`` counts code points from 0 to the value, without the name that it is assigned to. A null or empty text has none; a
    null id is kept; repeated rows give repeated findings. Other columns play no part.
    """
    rows = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), forest)
    f = rows.select("id", F.explode("__scored").alias("f"))
    return f.select("id", F.col("f.start").alias("start"), F.length("f.value").cast("long").alias("n_chars"), F.sha2("f.value", 256).alias("value_sha256"), F.round("f.score", 6).alias("score"), F.col("f.secret").alias("secret"))


def redact(docs: DataFrame, text_col: str = "text", forest: list | None = None) -> DataFrame:
    """``docs`` with each secret's value replaced by ``HIDDEN`` and, if there is such a column, ``n_chars`` set anew.

    No row goes, and no other character changes; null and empty texts and texts without secrets stay as they are. Repeated rows stay repeated, an empty
    table stays empty, and columns may have any names.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = scored(docs.toDF(*at.values()), forest, at[text_col])
    piece = f"case when i % 2 = 1 and __scored[int((i - 1) / 2)].secret then concat(left(p, length(p) - length(__scored[int((i - 1) / 2)].value)), '{HIDDEN}') else p end"
    rows = rows.withColumn("__hit", F.expr("coalesce(exists(__scored, f -> f.secret), false)"))
    rows = rows.withColumn(at[text_col], F.when(F.col("__hit"), F.expr(f"array_join(transform(__parts, (p, i) -> {piece}), '')")).otherwise(F.col(at[text_col])))
    if "n_chars" in at:
        n = at["n_chars"]
        rows = rows.withColumn(n, F.when(F.col("__hit"), F.length(at[text_col]).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(n)))
    return rows.select(*[F.col(k).alias(c) for c, k in at.items()])
