"""Secrets are found whole, whatever their length and whatever stands before them."""

import hashlib

import numpy as np
import pytest

from meshloom.llm import secret_scan

MIX = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def some(n, seed=3):
    return "".join(MIX[i] for i in np.random.default_rng(seed).integers(0, len(MIX), n))


JWT = f"eyJ{some(37)}.eyJ{some(350)}.{some(86)}"
#: (text before the value, value, text after it, whether the forest must take it for a secret)
CASES = [
    ('set token="', JWT, '" here', True),
    ("sent bearer ", JWT, " to it", True),
    ("a secret key ", some(700), " of ours", True),
    ("https://joe:", some(90), "@host.net", True),
    ("use AWS_K=", some(40), " there", False),
    ("visit host.net/path?k=", some(30), " there", False),
    ("dbPassword=", some(14), " there", True),
    ("Mypassword=", some(18), " there", True),
    ("mypassword: ", some(201), " there", True),
    ('password = "', some(513), '" there', True),
    ('password = "', some(5000), '" there', True),
    ("ghp key ghp_", some(120), " there", False),
    ("password:    '", "hQ8z!kk20sPq9", "' there", True),
    ('password = "', "correct horse, battery staple 77", '" there', True),
    ('"password": "', "ab'cd<ef>gh12XyZ", '", there', True),
    ("db_pass=", "Zx81kQpL0m", " there", True),
    ('auth_token :=  "', 'a\\"b9Kq,Zz81;Lm0', '" there', False),
]


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame([(i, a + v + b, len(a + v + b)) for i, (a, v, b, _) in enumerate(CASES)], "doc_id long, text string, n_chars long")
    forest = secret_scan.train(spark)
    return secret_scan.findings(d, forest=forest).collect(), {r.doc_id: r.text for r in secret_scan.redact(d, forest=forest).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_whole_values(found, case):
    before, value, after, sure = CASES[case]
    rows, redacted = found
    whole = {value, "ghp_" + value, "joe:" + value}
    hit = [r for r in rows if r.id == case and r.value_sha256 in {hashlib.sha256(v.encode()).hexdigest() for v in whole}]
    assert len(hit) == 1 and hit[0].n_chars >= len(value)
    if sure:
        assert hit[0].secret and not any(value[i : i + 12] in redacted[case] for i in range(0, len(value) - 12, 12))


def test_other_characters_stay(spark):
    """Noncharacters, the replacement sign and line ends are no marks: only the value changes."""
    odd = "a\ufdd0b\ufdd0 \ufdef\n\t\r 🙂 "
    rows = [(1, f"{odd}password = \"{some(20)}\"{odd}"), (2, odd), (3, "\ufdd0"), (4, None), (5, "")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, `__parts` string, `a.b` string")
    forest = secret_scan.train(spark)
    out = secret_scan.redact(d, forest=forest)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == d.columns
    assert got == {1: f'{odd}password = "[REDACTED]"{odd}', 2: odd, 3: "\ufdd0", 4: None, 5: ""}
    (only,) = secret_scan.findings(d.select("doc_id", "text"), forest=forest).collect()
    assert (only.id, only.start, only.n_chars) == (1, len(odd) + len('password = "'), 20)


def scanned(text):
    """Assigned values by hand: a name, up to 40 word characters, a sign, any blanks, and what follows to the same quote or to the next blank or sign."""
    names = "password passwd passphrase pwd secret token apikey api_key api-key accesskey access_key access-key authkey auth_key auth-key privatekey private_key private-key clientsecret client_secret client-secret credential pass auth".split()
    at, out = 0, []
    while at < len(text):
        best = None
        for name in names:
            if text[at : at + len(name)].lower() == name and not (name in ("pass", "auth") and text[at + 4 : at + 5] in set(MIX[:52])):
                for extra in range(40, -1, -1):
                    i = at + len(name) + extra
                    if i > len(text) or not all(c in MIX + "_-" for c in text[at + len(name) : i]):
                        continue
                    for quote in ((1, 0) if text[i : i + 1] in ("'", '"') and text[i : i + 1] else (0,)):
                        j = i + quote
                        while text[j : j + 1].isspace():
                            j += 1
                        sign = next((s for s in (":=", "=>", ":", "=") if text.startswith(s, j)), None)
                        if sign and best is None:
                            k = j + len(sign)
                            while text[k : k + 1].isspace():
                                k += 1
                            end = None
                            if q := text[k : k + 1].strip("".join(set(text) - set("\"'"))):
                                k += 1
                                close = k
                                while close < len(text) and text[close] not in q + "\n":
                                    close += 1
                                if text[close : close + 1] == q and close - k >= 4:
                                    end = close
                            if end is None:
                                end = k
                                while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>,;":
                                    end += 1
                            if end - k >= 4:
                                best = (k, text[k:end], end)
        if best:
            out.append(best[:2])
            at = best[2]
        else:
            at += 1
    return out


def test_candidates_by_hand(spark):
    r = np.random.default_rng(6)
    pick = lambda *a: a[int(r.integers(len(a)))]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(int(r.integers(1, 5))):
            parts.append(pick("see ", "my", "DB_", "x.") + pick("password", "Token", "api_key", "SECRET", "pwd", "other", "client-secret", "db_pass", "passes", "Auth") + pick("", "_v", "Name") + pick("", '"', "'") + pick("=", ": ", " := ", " => ", " ", "    =") + pick("", '"', "'") + some(int(r.integers(1, 15)), int(r.integers(99))) + pick("", "", " and, more;") + pick("", '"', "'"))
        texts.append(pick(" ", "; ", ", ").join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(f.start, f.value) for f in r["__found"] if f.named] for r in secret_scan.with_features(secret_scan.candidates(d)).collect()}
    assert got == {i: scanned(t) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"token={some(8, i)}" for i in range(1500))
    (row,) = secret_scan.with_features(secret_scan.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert [text[f.start : f.start + 8] for f in row["__found"]] == [some(8, i) for i in range(1500)]
