"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names; and
versions by brute force where SQL can't express an operator."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, bloom, line_dedup, mixing, near_dups, packing, pii, quality, queries, secrets, token_files, tokens, warc
from lexloom.llm.common import fresh_path
from tests.conftest import canonical

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, a string, size long, start int, kept string, drop string, h string"


def docs(spark, *rows):
    """Documents (doc_id, text, source), with columns whose names operators use themselves."""
    full = [(i, t, "en", s, len(t) if t is not None else None, 1, "k", "a", 2, 3, "x", "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def written(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ROWS = [(1, "One two three four five six.\nSame line here now.\n\nTail", "b"), (2, "Same line here now.\nOther", "b"), (2, "Same line here now.\nOther", "b"), (3, None, None), (4, "", "a"), (7, "Ends <|endoftext|> and <|StartOfText|><|startoftext|>!", "a"), (None, "Same line here now.", "a"), (5, LONG, "c"), (6, " \t\n", "c")]


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n != "op2_neighbours"))
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_queries_take_odd_tables(spark, tmp_path, name, rows):
    if name == "op7_warc":
        df = spark.createDataFrame([(i, "u", t, 1) for i, t, _ in rows], "page_id long, url string, html string, block int")
        folder = written(spark, tmp_path, "pages", df)
    else:
        folder = written(spark, tmp_path, "documents", docs(spark, *rows))
    got = queries.QUERIES[name](spark, folder).collect()
    if name != "op6_pack":
        assert len(got) == len(rows)
    if name in queries.ORACLE and rows:
        import duckdb

        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id <> 2 AND doc_id IS NOT NULL")
        plain = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id <> 2")
        other = written(spark, tmp_path / "plain", "documents", plain)
        assert canonical(queries.QUERIES[name](spark, other).toPandas()) == canonical(con.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, sf, name):
    assert canonical(queries.QUERIES[name](spark, sf).toPandas()) == canonical(duck.sql(queries.ORACLE[name]).df())


# --- 1 ----------------------------------------------------------------------------------------------------------------------
def test_mix_takes_budgets_exactly(spark):
    rows = [(i, ["a", "b", None][i % 3], i % 7) for i in range(300)] + [(1000, "tiny", 1)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), rows_a_range=16).toPandas()
    total = sum(r[2] for r in rows)
    per = out.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(per["target"].sum() - total) < 1e-6
    assert (per["taken"] == np.floor(per["target"])).all()
    assert (per["target"] <= 3 * per["size"] + 1e-9).all() and (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long"), rows_a_range=16).toPandas()
    assert canonical(out) == canonical(again)


def test_targets_fill_up_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (5, 2, 1), 3).collect()}
    assert got["a"] == 30 and got["d"] == 0
    assert got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(2010)


def test_mixed_documents_repeat_and_cut(spark):
    df = docs(spark, *[(i, f"d{i} x y z", "a") for i in range(4)], *[(10 + i, "p q\tr  s", "b") for i in range(20)])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()
    assert {r[0]: r[1] for r in words} == {"a": 48, "b": 48}


# --- 2 ----------------------------------------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string, dim string")


def test_neighbours_of_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1, "s", "d"), (1, [1.0, 0.0], 1, "s", "d"), (50, [0.0, 1.0], 1, "s", "d"), (2, [0.0, 0.0], 1, "s", "d"), (3, None, 1, "s", "d"), (4, [1.0, None], 1, "s", "d"), (5, [float("nan"), 1.0], 1, "s", "d"), (6, [1.0, 1.0, 1.0], 1, "s", "d"), (None, [1.0, 1.0], 1, "s", "d"), (7, [2.0, 0.0], 1, "s", "d"), (7, [2.0, 0.0], 1, "s", "d")]
    out = ann.op2_neighbours(spark, written(spark, tmp_path, "embeddings", vectors(spark, rows))).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in out] == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 7, 0.0)]


def test_neighbours_of_none(spark, tmp_path):
    assert ann.op2_neighbours(spark, written(spark, tmp_path, "embeddings", vectors(spark, []))).count() == 0


def test_recall_over_several_shards(spark):
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[3]
    rows = ann.usable(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]))
    out = ann.neighbours(ann.index(rows, shard=300), rows.where("vec_id % 50 = 0")).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, part in out.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len({*best} & {*part["vec_id"]})
    assert hits >= 0.9 * 5 * 30
    same = out[out["query_id"] == 750].sort_values("rank")["vec_id"].tolist()
    assert same == [3, 700, 701, 702, 703]


# --- 3, 6 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_ids_round_trips(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack(data, bits, 1001) == ids).all()


def test_shards_give_every_range_back(tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(1).integers(0, 1000, 5000).astype(np.uint32)
    places = np.array([0, 0, 10, 4000, 5000])
    with open(tmp_path / "s", "wb") as sink:
        w = token_files.ShardWriter(sink, 10, block=64)
        w.add(ids[:4000], places[:4], np.array([5, 6, 7]), np.zeros(3))
        w.add(ids[4000:], np.array([0, 1000]), np.array([8]), np.ones(1))
        w.close()
    r = token_files.ShardReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "s")))
    for a, b in ((0, 5000), (63, 65), (64, 128), (4999, 5000), (7, 7)):
        assert (r.read(a, b) == ids[a:b]).all()
    assert (r.document(2) == ids[10:4000]).all() and len(r.document(0)) == 0 and r.nulls.tolist() == [0, 0, 0, 1]


def test_ids_are_those_of_the_library():
    random.seed(2)
    from tokenizers import Tokenizer

    enc, plain = tokens.Encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    parts = ["a", "B", "'", "s", "T", " ", "\n", "é", "é", "́", "̸", "=", ".", "9", "²", " ", "ß", "İ", "Σ", "한", "ᄒ", "ᅡ", "😀", "J", "̌", "_", "-", "the", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "ñ", "Ñ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(25))) for _ in range(5000)] + [None, "", " "]
    ids, places = enc.encode(pa.array(texts, pa.string()))
    want = plain.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert any(49406 in x.ids for x in want) and any(49407 in x.ids for x in want)
    assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [x.ids + [1] for x in want]


def test_token_files_and_pieces_of_odd_texts(spark):
    df = docs(spark, *ROWS)
    enc = __import__("tokenizers").Tokenizer.from_file(tokens.default_path())
    want = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in ROWS}
    folder = fresh_path(spark, "t")
    got = token_files.read_token_files(token_files.write_token_files(df, folder, tokens.default_path(), block=1024), folder).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    packed = packing.pack(packing.pieces(df, tokens.default_path(), 64), 64, rows_a_range=2).toPandas()
    for r in packed.itertuples():
        ids = want[None if r.doc_id != r.doc_id else int(r.doc_id)][r.start : r.start + r.length]
        assert r.length == len(ids) and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    packed = packed.sort_values(["sequence_id", "offset"])
    assert (packed["offset"] == packed.groupby("sequence_id")["length"].cumsum() - packed["length"]).all()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 64 and packed["length"].sum() == at


def test_fullest_combination_against_all_subsets():
    random.seed(6)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(5)}
        room = random.randint(1, 60)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for s in (sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(1 << len(items))) if s <= room)
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in chosen) == best and all(n <= counts[k] for k, n in chosen)


def test_patterns_use_every_piece_once():
    histogram = {4096: 3, 4095: 1, 2048: 5, 1: 4, 700: 11}
    used: dict[int, int] = collections.Counter()
    for times, parts in packing.patterns(histogram):
        assert sum(k * n for k, n in parts) <= 4096
        used.update({k: n * times for k, n in parts})
    assert used == histogram
    assert packing.patterns({}) == []


# --- 4 ----------------------------------------------------------------------------------------------------------------------
def test_quality_rejects_what_lines_deplete(spark):
    common = "this very line stands in many documents of the host and has fourteen words"
    rows = [(i, f"{common}\nUnique words number {i} that {i * 7} are quite {i * 13} different from all others {i * 31} ok", "h") for i in range(12)]
    rows += [(100, f"{common}\nshort", "h"), (101, f"{common}\nshort", "other"), (102, "a b c d e f g h i j k l m", "h")]
    df = docs(spark, *rows)
    got = {r["doc_id"]: r for r in quality.judged(df, least_docs=5, least_share=0.1).collect()}
    assert not got[100]["kept"] and got[101]["kept"] and got[102]["kept"] and got[0]["kept"]
    out = quality.cleaned(df, least_docs=5, least_share=0.1)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == df.columns and common not in texts[0] and common in texts[101] and 100 not in texts and texts[102] == rows[-1][1]


def test_repeated_words_count_each_place_once(spark):
    cases = {"a b c d e x a b c d e": 10, "a a a a a a": 6, "a a a a a": 0, "a b c d e f": 0, "": 0}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", quality.repeated_words(F.regexp_extract_all("t", F.lit(r"\S+"), F.lit(0))).alias("n"))
    assert {r["t"]: r["n"] for r in rows.collect()} == cases


# --- 5, 9 -------------------------------------------------------------------------------------------------------------------
def luhn(x):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def private(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(x := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(x)]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def secret(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def spell(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


PRIVATE_PARTS = ["a.b@c.de", "x_y@z@w.com", "é@b.cd", "a@b.c_d@e.fg", "1.2.3.4", "256.1.1.1", "00001.2.3.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (403) 555-9312", "+44 20.7946 0958-", "+1+1 23", " ", ".", "-", "😀", "9" * 25, "\n", "@", "+"]
SECRET_PARTS = ["password", "Token", "API_KEY", "apikey", "secret", " ", "=", ":", '"', "'", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "g", "feedbeef", "token=token=abcdefghijklmnop", "paſsword:abcdefghijklmno", "\n", "😀"]


@pytest.mark.parametrize("operator,parts,base", [(pii, PRIVATE_PARTS, private), (secrets, SECRET_PARTS, secret)], ids=["pii", "secrets"])
def test_base_spans_are_those_of_the_patterns(spark, operator, parts, base):
    random.seed(9)
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(9))) for _ in range(3000)] + ["1" * 30_000, "a." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + " 1" * 20_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in operator.detected(df).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[i]["base"]] == want, t
        assert set(want) <= {(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[i]["all"]}


def test_random_tokens_are_told_from_others(spark):
    random.seed(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(random.choice(alphabet) for _ in range(64)) for _ in range(20)]
    plain = ["Aa1" * 20 + "bB2" * (i % 3) for i in range(40)]
    rows = [(i, f"key {k} end") for i, k in enumerate(keys)] + [(100 + i, f"id {p} end") for i, p in enumerate(plain)]
    got = {r["doc_id"]: [s["kind"] for s in r["all"]] for r in secrets.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == ["random"] for i in range(20)) >= 18
    assert sum(bool(got[100 + i]) for i in range(40)) == 0
    assert secrets.redacted(spark.createDataFrame([(1, f"password: {keys[0]} x")], "doc_id long, text string")).first()["text"] == "[SECRET] x"


# --- 7 ----------------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark):
    rows = [(1, "u", "x" * 50_000), (2, "u", "x" * 50_000), (3, None, None), (4, "a\r\nb", ""), (5, "u", "é" * 9_000), (5, "u", "é" * 9_000), (7, "u", "short"), (None, "u", "short")]
    folder = fresh_path(spark, "w")
    listed = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, segment=4096, chunk=1000)
    got = warc.read_archives(listed, folder).collect()
    by = collections.defaultdict(list)
    for i, _, t in rows:
        by[(t or "").encode()].append(i)
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == max(x or -1 for x in ids) else "revisit", None if i == max(x or -1 for x in ids) else max(x or -1 for x in ids), True) for b, ids in by.items() for i in ids]
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["intact"]) for r in got], key=str) == sorted(want, key=str)


def test_damaged_chains_are_told():
    whole = [warc.records(__import__("io").BytesIO(zlib_gzip(b"".join(warc.page_records(1, "u", b"y" * 900, None, False, 300, 100)))))]
    rows = [{"origin": "o", "number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "page_id": 1, "url": "u", "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": b} for f, b in whole[0]]
    assert warc._assembled(rows)[0]["intact"] and warc._assembled(rows)[0]["payload_bytes"] == 900
    assert not warc._assembled(rows[:1] + rows[2:])[0]["intact"]
    assert not warc._assembled(rows[:-1])[0]["intact"]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def zlib_gzip(data):
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# --- 8 ----------------------------------------------------------------------------------------------------------------------
def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def reachable(rows, share):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= share * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block,share", [(512, 85), (3, 85), (512, 80), (3, 80)])
def test_near_duplicates_against_all_pairs(spark, block, share):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = random.choices(vocabulary, k=random.choice([6, 40, 90]))
        for _ in range(random.choice([2, 12, 25])):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows) * 3 % 101 + 200 * (len(rows) // 101), " ".join(own).upper() if random.random() < 0.2 else " ".join(own)))
    rows += [(9001, "hi there"), (9002, "Hi  THERE"), (9003, ""), (9004, None), (9005, "hi"), (9006, "É x"), (9007, "é x")]
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs(spark, *[(i, t, "s") for i, t in rows]), share, block=block).collect()}
    want = reachable(rows, share)
    for i, t in rows:
        assert got[i]["n_shingles"] == len(shingles(t))
        assert (got[i]["component_id"], got[i]["kept"]) == (want[i], want[i] == i), (i, t)


def test_one_document_of_each_group_stays(spark):
    df = docs(spark, (3, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (1, "z", "s"), (None, "a b c d e f g", "s"))
    out = near_dups.without_near_duplicates(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 2, None}


# --- 10 ---------------------------------------------------------------------------------------------------------------------
def test_filters_forget_nothing():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = bloom.Pair(1 << 16), bloom.Pair(1 << 16)
    a.add(keys[:3000])
    a.add(keys[100:200])
    b.add(keys[2500:])
    bloom.merge(a.once, a.twice, b.once, b.twice)
    assert bloom.has(a.once, bloom.positions(keys, 1 << 16)).all()
    twice = bloom.has(a.twice, bloom.positions(keys, 1 << 16))
    assert twice[100:200].all() and twice[2500:3000].all() and not twice.all()


def test_a_full_filter_changes_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    full = line_dedup.without_repeats(df, filter_bytes=64, digest=True).toPandas()
    assert canonical(full) == canonical(line_dedup.without_repeats(df, digest=True).toPandas())


def test_documents_keep_their_columns(spark):
    df = docs(spark, (1, "A shared line here\nx", "s"), (2, " a SHARED line here \ny", "s"), (3, None, "s"), (None, "A shared line here", "s"))
    out = line_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "A shared line here\nx", 20), (2, "y", 1), (3, None, None), (None, "A shared line here", 18)}


def test_everything_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_recall_of_the_query(spark, sf, tmp_path):
    """op2_neighbours itself against brute force, over a table of its own with repeated rows, and over that of the driver."""
    rng = np.random.default_rng(5)
    own = rng.normal(size=(900, 24)).astype(np.float32).tolist()
    rows = [(i, x, 0, "s", "d") for i, x in [*enumerate(own), (50, own[50]), (50, own[51]), (951, own[7]), (1000, own[7]), (None, own[3]), (1050, [0.0] * 24)]]
    made = written(spark, tmp_path, "embeddings", vectors(spark, rows))
    for folder in (made, sf):
        t = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().drop_duplicates("vec_id") if folder == sf else pd.DataFrame(rows, columns=["vec_id", "embedding", "label", "shard", "dim"])
        t = t[t["vec_id"].notna() & t["embedding"].map(lambda v: any(v))]
        x, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy().astype(np.int64)
        got: dict = collections.defaultdict(dict)
        for r in queries.QUERIES["op2_neighbours"](spark, folder).collect():
            got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
        hits = total = 0
        for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
            scores: dict = {}
            for v in x[ids == q]:
                for i, s in zip(ids.tolist(), (x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v)).tolist()):
                    if i != q:
                        scores[i] = max(s, scores.get(i, -2))
            want = sorted(scores.items(), key=lambda p: (-round(p[1], 12), p[0]))[:5]
            assert sorted(got[q]) == list(range(1, len(want) + 1))
            assert all(abs(scores[i] - s) < 1e-12 for i, s in got[q].values())
            hits += len({i for i, _ in want} & {i for i, _ in got[q].values()})
            total += len(want)
        assert hits >= 0.9 * total and total >= 50
