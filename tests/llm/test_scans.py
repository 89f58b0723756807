"""Personal data and secrets against plain patterns, and what the methods add."""

import hashlib
import math
import random
import re

import pytest

from wavetally.llm import pii, secrets as sec

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def pii_row(t):
    out = []
    for i, (k, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[k]:
                out.append((m.start(), i, f"{k}:{m.start()}:{m.end()}", k))
    s = ",".join(x[2] for x in sorted(out))
    return tuple(sum(x[3] == k for x in out) for k in PLAIN), hashlib.sha256(s.encode()).hexdigest(), s


def secret_row(t):
    pats = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}", k) for i, (k, p, f, ok) in enumerate(pats) for m in re.finditer(p, t or "", f) if ok(m)]
    s = ",".join(x[2] for x in sorted(out))
    return tuple(sum(x[3] == k for x in out) for k in ("assign", "access", "hex")), hashlib.sha256(s.encode()).hexdigest(), s


def noise(alphabet, n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


PII_TEXTS = [
    None, "", "é😀 a@b.c x", "a@b@c.d", "a@b.c%d@e.f", "..@..@x.y.z-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.0001.9 1.2.3", "99999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112", "4111  1111 1111 1111", "4111111111111111111111", "+1 (743) 555-3824 +12 345 +1.2.3.4.5.6.7.8.9.0.", "+1 23456789012345678", "++1234567890", "x" * 5000 + "@a.b", "1" * 3000, "a@" * 500,
    "4111111111111111+4111111111111111@x.y",
]


def test_pii_equals_plain_patterns(spark):
    texts = [*PII_TEXTS, *noise("0123456789.-+ ()@ab", 300, 1), *noise("0123456789 -", 200, 2), *noise("a@.-1", 200, 3)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, rid int, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        counts, digest, spans = pii_row(t)
        r = got[i]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, digest), (t, r)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_pii_discovers_by_context(spark):
    rows = [f"call me at number {'+1 (555) 010-%04d' % i} or later" for i in range(12)] + ["call me at number 555.0109.77 or later", "room 555010977 is free", "version 20 or later"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[12] == "phone:18:29"
    assert got[13] == got[14] == ""


def test_pii_discovers_at_the_ends_of_a_text(spark):
    rows = [f"phone {'+1 (555) 010-%04d' % i} w{i}x" for i in range(12)] + ["phone 555.0109.77", "555.0109.77 phone", "phone" + " " * 90 + "555.0109.77", "w" * 90 + " 555.0109.77"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[12] == "phone:6:17" and got[14] == "phone:95:106" and got[13] == got[15] == ""


def test_pii_is_linear_in_a_text(spark):
    from time import time

    text = " ".join(f"n{i} 10.{i % 256}.7.{i % 199}" + (" a@b.c" if i % 50 == 0 else "") for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time()
    (r,) = pii.personal_data(df).collect()
    assert time() - began < 60
    counts, digest, spans = pii_row(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts and r.base_sha256 == digest


def plain_discoveries(texts):
    """The bootstrapped extraction in loops: mentions with their neighbours, three rounds over the graph, trusted patterns."""
    seen = []
    for d, t in enumerate(texts):
        base = [tuple(x.split(":")) for x in pii_row(t)[2].split(",") if x]
        base = [(int(a), int(b), k) for k, a, b in base]
        other = [(m.start(), m.end(), None) for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", t) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        for a, b, k in base + other:
            left, right = re.search(r"(\S+)\s*$", t[:a]), re.match(r"\S*\s+(\S+)", t[b:])
            l, r = left[1].lower() if left else "^", right[1].lower() if right else "$"
            seen += [(p, t[a:b].lower(), k, (d, a, b)) for p in (f"l {l}", f"r {r}", f"b {l} _ {r}")]
    kind = {}
    for p, v, k, _ in seen:
        kind[p, v] = max(kind.get((p, v)) or "", k or "") or None
    score = {(v, k): 1.0 for (_, v), k in kind.items() if k}
    seeds = dict(score)
    for _ in range(pii.ROUNDS):
        got = {}
        for p, v in kind:
            for (w, k), s in score.items():
                if w == v:
                    got.setdefault((p, k), []).append(s)
        total = {}
        for p, _ in kind:
            total[p] = total.get(p, 0) + 1
        patterns = {pk: (sum(s >= 1 for s in x), sum(x) / (total[pk[0]] + 2)) for pk, x in got.items()}
        heard = {}
        for (p, v), k in kind.items():
            if k is None:
                for (q, told), (_, s) in patterns.items():
                    if q == p:
                        heard.setdefault((v, told), []).append(s)
        score = dict(seeds) | {x: min(sum(s) / len(s), 0.999) for x, s in heard.items() if x not in seeds}
    trusted = {pk for pk, (n, s) in patterns.items() if n >= pii.MIN_SEEDS and s >= pii.TRUST}
    out = {}
    for p, v, k, where in seen:
        for q, told in trusted:
            if k is None and q == p and ("@" in v if told == "email" else sum(c in "0123456789" for c in v) >= pii.MIN_DIGITS):
                out[where] = min(out.get(where, told), told)
    return {(*w, k) for w, k in out.items()}


def test_pii_discoveries_equal_plain_loops(spark):
    r = random.Random(2)
    texts = []
    usual = {"dial phone": [f"+1 (555) 010-{i:04d}" for i in range(40)], "mail me:": [f"n{i}@x.org" for i in range(40)], "host": [f"10.0.0.{i}" for i in range(40)]}
    for i in range(160):
        before = r.choice([*usual, "room", ""])
        number = r.choice(usual[before]) if before in usual and r.random() < 0.9 else r.choice([f"555.{i:04d}.77", f"{i}", f"n{i}@local", f"7{i:05d}"])
        behind = r.choice(["now", "or later", ""])
        texts.append(f"{before} {number} {behind}".strip() if r.random() < 0.8 else f"x {number}, see {before} 12345678 {behind} y")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set()
    for row in pii.personal_data(df).collect():
        base = set(pii_row(texts[row.doc_id])[2].split(","))
        got |= {(row.doc_id, int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in row.spans.split(",") if x and x not in base}
    assert got == plain_discoveries(texts) and got


def test_pii_uses_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    found = pii.matches(df)
    for part in (found, pii.mentions(found), pii.discover(pii.mentions(found)), pii.personal_data(df)):
        assert not re.search("Python|Pandas|Arrow", part._jdf.queryExecution().toString())
    code = open(pii.__file__).read()  # and the plans before the written tables, which those do not show
    assert not re.search(r"import (pandas|numpy|pyarrow)|udf|mapIn|applyIn|\.rdd|collect\(\)|toPandas", code)


def test_secrets_equal_plain_patterns(spark):
    texts = [None, "", "token = 'abcdef'", "TOKEN=abc", "api_key:  secret=abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A1" * 8 + "x", "😀 " + "0a" * 12, "f" * 23, *noise("tokensecret=: '\"abc0", 300, 4), *noise("AKI0f", 200, 5)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rid int").repartition(3)
    got = {r.doc_id: r for r in sec.secrets(df).collect()}
    for i, t in enumerate(texts):
        counts, digest, spans = secret_row(t)
        assert ((got[i].n_assign, got[i].n_access, got[i].n_hex), got[i].base_sha256) == (counts, digest), t
        assert set(filter(None, spans.split(","))) <= set(got[i].spans.split(","))


def test_secrets_discover_random_tokens(spark):
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choices(letters, k=60)) for _ in range(5)]
    words = ["".join(r.choices(["ation", "th", "er", "ing", "Re", "con", "s", "e", "ment"], k=12))[:40] + str(i % 3) for i in range(300)]
    rows = [f"use {k} here" for k in keys] + [f"see {w} here" for w in words]
    got = {x.doc_id: x.spans for x in sec.secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum("random:4:64" in got[i] for i in range(5)) >= 4
    assert sum(got[i] != "" for i in range(5, len(rows))) <= 3


def test_battery():
    r = random.Random(1)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(300)]
    rejected = sum(sec.battery(h, sec.ALPHABETS["hex"])[1] < 0.01 for h in hexes)
    assert rejected <= 15
    assert sec.battery("0123456789abcdef" * 3, sec.ALPHABETS["hex"])[1] < 0.01
    assert sec.battery("a" * 30, sec.ALPHABETS["hex"])[1] < 1e-6
    assert [sec.encoding_of(t) for t in ("123", "12ab", "12AB", "XYZ7", "abc", "abcZ", "ab9z", "aZ9", "a+Z9==", "a_Z9", "a+_")] == ["decimal", "hex", "upper_hex", "base32", "hex", "letters", "base36", "base62", "base64", "base64url", None]


@pytest.mark.parametrize("f", [pii.personal_data, sec.secrets])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_behind_a_name(spark):
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(r.choices(letters, k=60))
    words = ["".join(r.choices(["ation", "th", "er", "ing", "Re", "con", "s", "e", "ment"], k=12))[:40] + str(i % 3) for i in range(300)]
    rows = [f"sessionid={key()}; x" for _ in range(3)] + [f"a_long_name_of_words+{key()} x" for _ in range(3)] + [f"see {w} here" for w in words]
    got = {x.doc_id: x.spans for x in sec.secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum("random:10:70" in got[i] for i in range(3)) >= 2 and sum(":81" in got[i] for i in range(3, 6)) >= 2
    assert sec.tokens_of("sig=" + "aZ3" * 8 + "== k=" + "b" * 20 + "=c") == [(4, 30, "aZ3" * 8 + "=="), (33, 53, "b" * 20)]
    mixed = "_" + "a+/Z" * 6 + "-x"
    assert (1, 25, "a+/Z" * 6) in sec.tokens_of(mixed)


B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
NAMES = "the and value index count user name table reader window of to in make result partition key handler get set from list config manager error state item buffer size node path".split()


def corpus(n_keys, n_names, length, seed):
    """Texts of ordinary words, each with one random token or one long name of words."""
    r = random.Random(seed)
    keys = ["".join(r.choices(B62, k=length)) for _ in range(n_keys)]
    names = ["".join(w.capitalize() for w in r.choices(NAMES, k=9))[: r.randint(max(20, length - 4), length + 6)] + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n_names)]
    told = lambda: " ".join(r.choice(NAMES) for _ in range(20)) + f" in {r.randint(1, 3000)}. "
    return keys, names, [(i, told() + x + " " + told().capitalize()) for i, x in enumerate(keys + names)]


def plain_choice(rows):
    """The tokens that pass, by loops: ordinary characters, p-values, and the rule of Benjamini and Hochberg in each stratum."""
    heard, tokens = [0] * 128, set()
    for _, t in rows:
        base = [(s, e) for s, e, _ in sec.base_spans(t)]
        taken = [m.span() for m in sec.TOKEN.finditer(t)] + base
        tokens |= {x for a, b, x in sec.tokens_of(t) if not any(s < b and a < e for s, e in base)}
        for i, c in enumerate(t):
            if c.isascii() and not any(s <= i < e for s, e in taken):
                heard[ord(c)] += 1
    strata = {}
    for t in tokens:
        k, n = sec.encoding_of(t), len(t.rstrip("="))
        if n < sec.MIN_TOKEN:
            continue
        q = [heard[ord(c)] + 0.5 for c in sec.ALPHABETS[k]]
        q = [x / sum(q) for x in q]
        chi, p = sec.battery(t, sec.ALPHABETS[k])
        even = sec.ordinary_p(chi, n, len(q), sum(x**2 for x in q), sum(x**3 for x in q))
        strata.setdefault((k, sum(n >= x for x in sec.STRATA)), []).append((int(min(sec.BINS, -math.log10(max(even, 1e-300)) * sec.PER_UNIT)), p, t))
    out = set()
    for found in strata.values():
        good = [b for b in {b for b, _, _ in found} if 10 ** (-b / sec.PER_UNIT) <= sec.FDR * sum(x >= b for x, _, _ in found) / len(found)]
        out |= {t for b, p, t in found if good and b >= min(good) and p >= sec.LEVEL}
    return out


@pytest.mark.parametrize("n_keys, n_names, length, least", [(40, 1500, 40, 0.9), (600, 600, 40, 0.9), (900, 300, 48, 0.95), (60, 600, 32, 0.6)])
def test_secrets_are_found_whatever_their_share(spark, n_keys, n_names, length, least):
    keys, names, rows = corpus(n_keys, n_names, length, n_keys)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.token for r in sec.random_tokens(sec.scan(df)).collect()}
    assert got == plain_choice(rows)
    assert len(got & set(keys)) >= least * n_keys and len(got & set(names)) <= 0.02 * len(got) + 1


def test_many_spans_of_one_text(spark):
    """A hundred thousand tokens in one text; a span that lies in a longer one of the same run is not listed."""
    r = random.Random(2)
    text = " ".join("".join(r.choices(B62, k=40)) for _ in range(100_000)) + " " + " ".join(NAMES * 3000)
    row = sec.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = row.spans.split(",")
    assert len(spans) > 95_000 and len(set(spans)) == len(spans)
    nested = [(1, [(0, 40), (0, 20), (5, 40), (5, 30), (41, 61), (50, 90), (60, 90)])]
    found = spark.createDataFrame([(i, s, e) for i, x in nested for s, e in x], "rid long, s int, e int")
    assert {(x.s, x.e) for x in sec.outermost(found).collect()} == {(0, 40), (41, 61), (50, 90)}
