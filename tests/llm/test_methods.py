"""The dealt methods of operators 4, 5 and 9 against plain versions, over made-up tables in which they act."""

from __future__ import annotations

import collections
import math
import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import pii, quality, secrets
from tests.llm.test_edges import WORD, docs, luhn, private

B64 = secrets.ALPHABETS["base64"][:64]


# --- 4 ----------------------------------------------------------------------------------------------------------------------
def verdicts(rows, least_docs, least_share, depleted):
    """kept, and the text without frequent lines, of each (doc_id, text, host) by number."""
    key = lambda line: " ".join(WORD.findall(line)).lower()
    distinct = {r for r in rows}
    size, held = collections.Counter(h for _, _, h in distinct), collections.Counter()
    for _, t, h in distinct:
        held.update({(h, key(x)) for x in (t or "").split("\n") if key(x)})
    common = {k for k, n in held.items() if n > least_docs and n > least_share * size[k[0]]}
    out = []
    for _, t, h in rows:
        lines, w = (t or "").split("\n"), WORD.findall(t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lost = sum(len(WORD.findall(x)) for x in lines if (h, key(x)) in common)
        kept = len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and lost <= depleted * len(w)
        out.append((kept, "\n".join(x for x in lines if (h, key(x)) not in common)))
    return out


def test_frequent_lines_by_documents_of_a_host(spark):
    random.seed(4)
    footers = [f"Footer {i} of this host says the very same thing in all its many documents always" for i in range(4)]
    rows = []
    for i in range(160):
        own = [" ".join(f"w{random.randrange(5000)}" for _ in range(random.choice([3, 12, 40]))) for _ in range(random.randrange(1, 5))]
        own += [f if random.random() < 0.5 else f"  {f.upper()}\t" for f in footers[: i % 5] if random.random() < 0.6]
        random.shuffle(own)
        rows.append((i, "\n".join(own), f"host{i % 3}" if i % 20 else None))
    copy = "A page that stands word for word under very many ids of one host\nand nothing else is in it at all but this"
    rows += [(1000 + i, copy, "host1") for i in range(30)] + [(2000, copy, "host2")] + [rows[0]] * 9 + [(3000, None, "host0"), (3001, "", None)]
    want = verdicts(rows, 8, 0.1, 0.8)
    df = docs(spark, *rows)
    got = {(r["doc_id"], r["host"]): r["kept"] for r in quality.judged(df, 8, 0.1, 0.8).collect()}
    assert got == {(i, h): k for (i, _, h), (k, _) in zip(rows, want)}
    texts = sorted((r["doc_id"], r["text"]) for r in quality.cleaned(df, least_docs=8, least_share=0.1, depleted=0.8).collect())
    assert texts == sorted((i, t) for (i, _, _), (k, t) in zip(rows, want) if k)
    # Copies under other ids are documents of their own: the page goes from its host, and stays in another.
    assert not got[1000, "host1"] and got[2000, "host2"]
    assert sum(t != r[1] for r, (k, t) in zip(rows, want) if k) > 20


# --- 5 ----------------------------------------------------------------------------------------------------------------------
def revealed(rows, generalise, remove, prior):
    """term and gone spans of each (doc_id, text), by definition: all pairs of entities and terms of each text."""
    group = {"email": lambda m: m.split("@")[-1], "ip": lambda m: ".".join(m.split(".")[:3]), "card": lambda m: re.sub("[^0-9]", "", m)[:6], "phone": lambda m: re.sub("[^0-9]", "", m)[:4]}
    texts = {t or "" for _, t in rows}
    ents, terms = {}, {}
    for t in texts:
        own = set()
        for a, _, b, kind in private(t):
            value = t[a:b] if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])
            own |= {(kind, value.lower()), (f"{kind} of", group[kind](t[a:b]).lower())}
        ents[t], terms[t] = own, {m.lower() for m in re.findall(r"[^\W\d_]{4,}", t)}
    n, n_e, n_t, joint = len(texts), collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        n_e.update(ents[t])
        n_t.update(terms[t])
        joint.update((e, w) for e in ents[t] for w in terms[t])
    share = {}
    for (e, w), j in joint.items():
        if n_e[e] < n:
            share[e, w] = round(math.log(j / (n_t[w] + prior) * n / n_e[e]) / math.log(n / n_e[e]), 9)
    out = {}
    for t in texts:
        spans = []
        for m in re.finditer(r"[^\W\d_]{4,}", t):
            best = max((share.get((e, m[0].lower()), -1) for e in ents[t]), default=-1)
            if best >= generalise and not any(a < m.end() and m.start() < b for a, _, b, _ in private(t)):
                spans.append((m.start(), m.end(), "gone" if best >= remove else "term"))
        out[t] = spans
    return out


def private_rows():
    random.seed(5)
    common = ["they", "often", "write", "about", "things", "which", "everyone", "knows", "mail", "calls", "card", "server"]
    rows = []
    for i in range(700):
        words = random.choices(common, k=random.randrange(3, 15))
        if i % 7 == 0:
            words.insert(2, f"person{'abcdefghij'[i // 7 % 10]}@{'quixotl' if i % 2 else 'velmar'}.example")
            words += random.sample(["Quixotl" if i % 2 else "Velmar", "headquarters", "rareterm" + "xyz"[i % 3]], 2)
        if i % 11 == 0:
            words.insert(1, random.choice(["10.1.2.3", "10.1.2.77", "+1 (403) 555-9312", "4111 1111 1111 1111"]))
            words.append(random.choice(["datacentre", "Calgary", "issuer"]))
        rows.append((i, " ".join(words)))
    names = " ".join(f"name{chr(97 + i // 26)}{chr(97 + i % 26)} p{i}@directory.example" for i in range(150))
    return rows + [(900, names), (901, "copied quokkas at lone@solo.example"), (902, "copied quokkas at lone@solo.example"), (903, None), (904, "")]


def test_disclosing_terms_against_all_pairs(spark):
    rows = private_rows()
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    for limits in ((0.9, 0.97, 0.5), (0.6, 0.8, 0.5), (0.75, 0.76, 2.0)):
        want = revealed(rows, *limits)
        got = pii.detected(df, *limits).collect()
        assert len(got) == len(rows) + 1
        by = dict(rows)
        for r in got:
            assert [(s["start"], s["end"], s["kind"]) for s in r["all"] if s["rank"] >= 4] == want[by[r["doc_id"]] or ""], by[r["doc_id"]]
            assert len(r["reveals"]) == len(want[by[r["doc_id"]] or ""])
        assert sum(map(len, want.values())) > 100
    kinds = {k for v in revealed(rows, 0.9, 0.97, 0.5).values() for _, _, k in v}
    assert kinds == {"term", "gone"}
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "[EMAIL]" in out[0] and "@" not in out[900] and out[903] is None and out[904] == "" and "[EMAIL TERM]" in out[901]


# --- 9 ----------------------------------------------------------------------------------------------------------------------
def tail(z):
    x = abs(z)
    t = 1 / (1 + 0.2316419 * x)
    p = math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return p if z >= 0 else 1 - p


def surprise(symbols, size):
    x, n = np.array(symbols, float), len(symbols)
    cells = max(2, min(size, n // 4))
    widths = np.bincount(np.arange(size) * cells // size, minlength=cells)
    seen = np.bincount((x.astype(int) * cells) // size, minlength=cells)
    chi = float((seen**2 / widths).sum() * size / n - n)
    spread = 2 / (9 * (cells - 1))
    z_chi = ((max(chi, 0) / (cells - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    up = x > (size - 1) / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        e = 2 * a * b / n + 1
        p_runs = 2 * tail(abs((1 + int((up[1:] != up[:-1]).sum()) - e) / math.sqrt(max(1e-9, (e - 1) * (e - 2) / (n - 1)))))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    p_serial = 2 * tail(abs((float((d[1:] * d[:-1]).sum()) / power + 1 / n) * math.sqrt(n))) if power > 1e-9 else 0.0
    h = -sum(math.log(max(1e-30, min(1.0, p))) for p in (tail(z_chi), p_runs, p_serial))
    return max(0.0, (h - math.log(1 + h + h * h / 2)) / math.log(2))


def encoded(token, code):
    t = token.lower() if code in ("hex", "base36") else token
    return [s - 2 if s >= secrets.SIZES[code] else s for s in (secrets.ALPHABETS[code].index(c) for c in t)]


def checks_of(token):
    """(encoding, length, surprise), and whether the token has the form of words, of one as the pattern finds it."""
    bare = re.sub("=+$", "", token)
    plain = bool(re.match(secrets.WORDS, bare) or re.match(secrets.SLUG, bare))
    codes = [c for c in secrets.ALPHABETS if re.match(secrets.FITS[c], bare)]
    return plain, [(c, len(bare), surprise(encoded(bare, c), secrets.SIZES[c])) for c in (codes if plain else codes[:1]) if len(bare) * math.log2(secrets.SIZES[c]) >= secrets.LEAST_BITS]


def made():
    """Steps of the made ordinary tokens by encoding and length class."""
    out, number = collections.defaultdict(list), 0
    for code, (capital, small, digit, digits) in secrets.PLACES.items():
        for length in range(secrets.SHORTEST, secrets.LONGEST + 1):
            for _ in range(secrets.DRAWS):
                seed = xxhash.xxh64_intdigest(number.to_bytes(8, "little"), 42)
                keys = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed) for k in range(5)]

                def draw(k, x, n):
                    h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), keys[k])
                    return (h - 2**64 if h >= 2**63 else h) % n

                symbols = []
                for i in range(math.ceil(2 ** (length / 2))):
                    if small is None or draw(0, i // 6, 4) == 0:
                        symbols.append(digit + draw(4, i, digits))
                    else:
                        letter = ord("etaoinshrdlcumwfgypbvkjxqz"[min(draw(2, i, 26), draw(3, i, 26))]) - 97
                        symbols.append((capital if i % 6 == 0 and draw(1, i // 6, 2) == 0 else small) + letter)
                out[code, length].append(min(secrets.MOST, int(surprise(symbols, secrets.SIZES[code]) * secrets.STEPS)))
                number += 1
    return out


def class_of(length):
    return min(secrets.LONGEST, int(2 * math.log2(length)))


def reported(tokens, ordinary):
    """Those of the different tokens that are reported."""
    calm, found = {k: list(v) for k, v in ordinary.items()}, collections.defaultdict(dict)
    for t in set(tokens):
        plain, tests = checks_of(t)
        for code, length, s in tests:
            at, step = (code, class_of(length)), min(secrets.MOST, int(s * secrets.STEPS))
            if plain:
                calm[at].append(step)
            else:
                found[at][t] = step
    out = set()
    for at, own in found.items():
        fine = [s for s in own.values() if (1 + sum(c <= s for c in calm[at])) / (1 + len(calm[at])) <= secrets.RATE * sum(x <= s for x in own.values()) / len(own)]
        out |= {t for t, s in own.items() if s <= max(fine, default=-1)}
    return out


def token_rows():
    rng = random.Random(12)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    tokens = [key(B64, n) for n in (22, 24, 32, 40, 64, 88, 300, 2000) for _ in range(12)] + [key(B64[:62] + "-_", 43) + "=" for _ in range(8)]
    tokens += [key("0123456789ABCDEF", n) for n in (64, 128, 256) for _ in range(10)] + [key("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n) for n in (128, 512) for _ in range(6)] + [key("0123456789abcdefghijklmnopqrstuvwxyz", n) for n in (100, 300, 700) for _ in range(6)]
    calm = ["Aa1" * k + "bB2" * (k % 3) for k in range(6, 40)] + ["report" + str(k) * 5 + "Final" * (k % 4 + 1) for k in range(30)] + ["A1b2C3d4" * k for k in range(2, 30)]
    calm += ["internationalisation", "Donaudampfschiffahrtsgesellschaft", "INTERNATIONALISATION", "getElementValueAndName", "path/to/some-other_place", "2024-01-15-some-title"]
    return tokens, calm


def test_surprise_is_that_of_the_plain_battery(spark):
    tokens, calm = token_rows()
    every = [*tokens, *calm, "k3jx9q2mz7w4vb8t", "QK7ZB4XLM2TNPR5W", "a" * 30 + "B1"]
    df = spark.createDataFrame(list(enumerate(every)), "i long, t string")
    for r in df.select("t", secrets.tested(F.col("t")).alias("x")).collect():
        want = checks_of(r["t"])[1]
        assert [(x["encoding"], x["length"]) for x in r["x"]] == [w[:2] for w in want]
        assert all(abs(x["surprise"] - w[2]) < 1e-6 * max(1, w[2]) for x, w in zip(r["x"], want)), r["t"]


def test_random_spans_are_those_of_the_plain_version(spark):
    tokens, calm = token_rows()
    rows = [(i, f"key {t} end") for i, t in enumerate([*tokens, *calm])] + [(5000 + i, f"again {tokens[30]}") for i in range(40)] + [(9000, None), (9001, "")]
    ordinary = made()
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["all"]] for r in secrets.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = reported([*tokens, *calm], ordinary)
    lower = {t for t in tokens if re.search("[0-9a-f]{16}", t)}  # a base span of its own
    for i, t in enumerate([*tokens, *calm]):
        if t not in lower:
            assert got[i] == ([(4, 4 + len(t), "random")] if t in want else []), t
    assert len(want & {*tokens}) > 0.75 * len(tokens) and not want & {*calm}
    assert all(got[5000 + i] == [(6, 6 + len(tokens[30]), "random")] for i in range(40)) and got[9000] == got[9001] == []


def test_what_is_reported_is_mostly_random(spark):
    """Ordinary tokens that no rule of form tells apart hardly add to what is reported, whatever their number."""
    rng = random.Random(3)
    words = ["report", "final", "Summary", "server", "North", "backup", "image", "Copy"]
    calm = {"".join(rng.choice(words) for _ in range(rng.randrange(2, 5))) + str(rng.randrange(10**4)) for _ in range(600)}
    keys = ["".join(rng.choice(B64) for _ in range(rng.choice([24, 40, 64]))) for _ in range(60)]
    rows = list(enumerate([*keys, *calm]))
    got = {r["doc_id"] for r in secrets.detected(spark.createDataFrame(rows, "doc_id long, text string")).where("exists(all, s -> s.kind = 'random')").select("doc_id").collect()}
    false = sum(i >= len(keys) for i in got)
    assert false <= 0.1 * len(got) and len(got) - false >= 30


def test_time_goes_with_the_length_of_a_token(spark):
    rng = random.Random(1)
    took = {}
    for n in (1000, 50_000, 100_000):
        df = spark.createDataFrame([("".join(rng.choices(B64, k=n)),)], "t string").select(F.size(secrets.tested(F.col("t"))).alias("n"))
        df.collect()
        began = time.perf_counter()
        assert df.collect()[0]["n"] == 1
        took[n] = time.perf_counter() - began
    assert took[100_000] < 3 * took[50_000] + 2


def test_luhn_of_the_fixture():
    assert luhn("4111111111111111")


def encodings(spark, tokens):
    """The encoding of each token that the pattern finds whole and that could be a secret, else None."""
    df = spark.createDataFrame(list(enumerate(tokens)), "i long, t string").select("i", (F.regexp_extract("t", secrets.TOKEN, 0) == F.col("t")).alias("m"), secrets.ordinary(F.col("t")).alias("plain"), secrets.tested(F.col("t")).alias("x"))
    return [r["x"][0]["encoding"] if r["x"] and r["m"] and not r["plain"] else None for r in df.orderBy("i").collect()]


def test_random_tokens_of_80_bits_are_tested(spark):
    rng = random.Random(8)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    short = [key(B64, 14) for _ in range(400)] + [key(B64, 20) for _ in range(400)]
    got = encodings(spark, short)
    assert sum(x == "base64" for x in got[:400]) >= 390 and sum(x == "base64" for x in got[400:]) >= 396
    assert encodings(spark, ["abQxRtYzWkLmPq", "QK7ZB4XLM2TNPR5W", "k3jx9q2mz7w4vb8t", "k3j-9q2_mz7w4vb8t", "a3F" * 4]) == ["base64", "base32", "base36", "base64", None]


def test_words_are_no_random_tokens(spark):
    words = ["internationalisation", "Donaudampfschiffahrt", "INTERNATIONALISATION", "getElementValueAndName", "path/to/some-other_place", "2024-01-15-some-title", "12345678901234567890"]
    assert encodings(spark, words) == [None] * len(words)
