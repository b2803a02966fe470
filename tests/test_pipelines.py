"""What whole pipelines are made of: odd inputs, and plain versions of what has no SQL or more than its SQL shows."""

import io
import time
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import attribution, coref, models, pipelines, simjoin, spans, spreadsheet
from lexloom.operators import corpus as O
from lexloom.operators import vectors as V
from lexloom.plans import pipeline_queries, registry
from lexloom.plans import vector_queries as VQ
from lexloom.sources import shared, tables, workbook


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- offsets ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 16_384, 16_385, 40_000])
def test_sums_before(spark, n):
    got = spark.range(1).select(T.sums_before(F.expr(f"transform(slice(sequence(0, {n}), 1, {n}), x -> x % 7)")).alias("x")).first()["x"]
    values = np.arange(n) % 7
    assert got == (np.cumsum(values) - values).tolist()


def test_offsets_take_time_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([("héllo wörld. " * (n // 2),)], "t string")
        df = df.select(F.size(spans.located_words(F.col("t"))).alias("w"), F.size(T.sentence_spans(F.col("t"))).alias("s"))
        assert df.first()["w"] == n
        began = time.perf_counter()
        df.collect()
        return time.perf_counter() - began

    assert took(32_000) < 3 * took(16_000) + 1


# --- vectors, similarity ----------------------------------------------------------------------------------------------------
def test_the_best_of_blocks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[40:140] = x[7]
    x[5] = 0
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame([*data, (900, [1.0]), (901, None), (902, [])], "id long, vector array<double>")
    q = spark.createDataFrame([*data[::10], (901, None)], "query_id long, vector array<double>")
    norm = np.linalg.norm(x, axis=1)
    for own in (False, True):
        pairs = V.blocks(q, v, 4, own=own, rows=17)
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in V._best(pairs, 4).collect()}
        with np.errstate(invalid="ignore"):
            s = np.round(x @ x.T / norm / norm[:, None], 6)
        for i in range(0, 300, 10):
            order = sorted((j for j in range(300) if j != 5 and (own or j != i)), key=lambda j: (-s[i, j], j))[:4]
            assert [got[i, k + 1] for k in range(4)] == [(j, s[i, j]) for j in order]
        assert len(got) == 30 * 4
    assert V.nearest(q.limit(0), v, 3).count() == 0 and V.nearest(q, v.limit(0), 3).count() == 0


def test_bands_find_what_the_exact_join_finds(spark, sf):
    sets = VQ.lines(spark, sf)
    exact, found = (rows(f(sets, 0.8)) for f in (simjoin.jaccard_pairs, simjoin.minhash_pairs))
    assert set(found) <= set(exact) and len(found) >= 0.99 * len(exact) and len(exact) > 100


def test_shortlist_has_near_and_alike(spark, sf):
    got = {r[:2] for r in rows(registry.QUERIES["d14_shortlist"](spark, sf))}
    text = {r["id"]: r["text"] for r in VQ.numbered(spark, sf).collect()}
    alike = [(r["i"], r["j"]) for r in simjoin.jaccard_pairs(VQ.lines(spark, sf), 0.8).collect()]
    words = lambda t: {w for w in t.lower().split() if w}

    def passes(a, b):
        x, y = words(a), words(b)
        return min(len(a), len(b)) >= 0.25 * max(len(a), len(b)) and len(x & y) >= 0.08 * len(x | y)

    assert {p for p in alike if passes(text[p[0]], text[p[1]])} <= got
    assert len(got) > len(alike) and all(i < j and passes(text[i], text[j]) for i, j in got)


def test_a_least_score_only_leaves_out(spark, sf):
    claims, sents = VQ.claims(spark, sf), VQ.sentences(spark, sf)
    for least in (0.05, 0.1, 0.3):
        assert rows(attribution.word_scores(claims, sents, least)) == rows(attribution.word_scores(claims, sents).where(F.col("score") >= least))
    none = spark.createDataFrame([(1, ""), (2, None)], "claim_id long, text string")
    assert attribution.word_scores(none, sents, 0.1).count() == 0


# --- chains, spans ----------------------------------------------------------------------------------------------------------
def test_pair_relations(spark):
    side = "struct<idx:int,start:int,end:int>"
    entries = [
        (1, 0, 0, (2, None, None), (0, None, None), None, "match", None),
        (1, 0, 1, (None, 0, 3), (None, 20, 22), 5, None, 0.7),
        (1, 0, 2, (1, None, None), (1, None, None), 4, None, 0.9),
        (1, 0, 3, (1, None, None), (2, None, None), None, " Pron-Pron-NC", 0.1),
        (1, 0, 4, (0, None, None), (1, None, None), None, "cousin", 0.2),
        (1, 0, 5, (None, 7, 8), (1, None, None), 4, None, 0.3),
        (1, 0, 6, (3, None, None), (4, None, None), None, None, 0.3),
    ]
    df = spark.createDataFrame(entries, f"doc_id long, chain_id int, pos int, a {side}, b {side}, id int, label string, score double")
    mentions = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 0, 1, 10, 12), (1, 0, 2, 20, 22), (1, 0, 3, 20, 22)], "doc_id long, chain_id int, idx int, start int, end int")
    assert rows(coref.pair_relations(df, mentions)) == [(1, 0, 0, 1, None, "COUSIN", 0.2), (1, 0, 0, 2, 4, "MATCH", 0.7), (1, 0, 1, 2, 2, "PRON_PRON_NC", 0.1)]


def test_chain_search(spark):
    spans_ = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 12, 14), (1, 2, 50, 60)], "doc_id long, span_id int, begin int, stop int")
    mentions = spark.createDataFrame([(1, 1, 3, 8, "Anna B"), (1, 1, 30, 33, "she"), (1, 2, 11, 20, "the house"), (1, 1, 95, 99, "away")], "doc_id long, chain_id int, start int, end int, text string")
    sents = spark.createDataFrame([(1, 0, 0, 25, ""), (1, 1, 26, 40, "")], "doc_id long, sentence_id int, start int, end int, text string")
    got = rows(coref.chain_search(coref.chain_of_span(spans_, mentions), mentions, sents))
    assert got == [(1, 0, 1, "Anna B", 3, [(0, True), (1, False)]), (1, 1, 2, "the house", 1, [(0, True)])]


def test_span_candidates(spark):
    sents = spark.createDataFrame([(1, 0, "the big house of the town and a tree")], "doc_id long, sentence_id int, text string")
    # the big house | of the | to town of the
    spans_ = spark.createDataFrame([(1, 0, 1, 0, 13), (1, 0, 2, 14, 20), (1, 0, 3, 14, 31)], "doc_id long, sentence_id int, span_id int, start int, end int")
    chunks = spark.createDataFrame([(1, 0, 4, 8, 13)], "doc_id long, sentence_id int, start int, head int, end int")
    got = rows(spans.span_candidates(spans_, sents, chunks, ("the", "of", "and", "a")).select("span_id", "rule", "start", "end"))
    assert got == [(1, 4, 4, 13), (1, 5, 8, 13), (1, 9, 0, 13), (2, 1, 4, 13), (2, 9, 14, 20), (3, 1, 4, 13), (3, 3, 21, 25), (3, 9, 14, 31)]


def test_engines_plug_in(spark):
    docs = spark.createDataFrame([(1, "Aachener sagen Aachener gern"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(O.engine_mentions(docs, lambda: O.repeated_words(8))) == [(1, 1, 0, 8, "Aachener"), (1, 1, 15, 23, "Aachener")]
    odd = lambda: lambda texts: [[[(0, 2), (5, 5), (3, 99), (-1, 2)]] if t else [] for t in texts]
    assert rows(O.engine_mentions(docs, odd)) == [(1, 1, 0, 2, "Aa")]


def test_gradients_of_a_trained_classifier(spark):
    rng = np.random.default_rng(9)
    words = ["plain", "words", "all", "over"]
    docs = [(i, " ".join(rng.permutation([*rng.choice(words, 6), "fine" if i % 2 else "junk"])), i % 2) for i in range(120)] + [(500, None, 1), (501, "fine", None)]
    weights = models.word_weights(spark.createDataFrame(docs, "doc_id long, text string, label int"))
    w = {r["token"]: r["weight"] for r in weights.collect()}
    assert w["fine"] > 0.5 > -0.5 > w["junk"] and all(abs(w[x]) < 0.3 for x in words)
    tokens = spark.createDataFrame([(1, "Fine,"), (2, "unknown"), (3, "--")], "pos int, token string")
    assert rows(models.gradients(tokens, weights).select("pos", "importance")) == [(1, w["fine"]), (2, 0.0), (3, 0.0)]
    # Held out: the sign of a text's sum tells its label.
    held = [(i, " ".join([*rng.choice(words, 5), "fine" if i % 2 else "junk"]), i % 2) for i in range(40)]
    assert all((sum(w[x] for x in t.split()) > 0) == bool(label) for _, t, label in held)


def test_candidates_of_unknown_kind(spark):
    with pytest.raises(ValueError):
        pipelines.candidates(spark.createDataFrame([], "doc_id long, sentence_id int, text string"), "none", models.Options())
    with pytest.raises(TypeError):
        models.Options(unknown=1)


# --- sources ----------------------------------------------------------------------------------------------------------------
def test_workbooks(spark):
    assert [workbook.column_number(x) for x in ("A1", "Z9", "AA10", "AB3")] == [1, 26, 27, 28]
    book = pipeline_queries._workbook([(1, "é<&>"), (2, "x"), (3, "")])
    assert workbook.sheet_cells(book, 3) == [(1, 1, "1", None, None), (1, 2, "é<&>", None, None), (1, 28, None, "FF00C000", None), (2, 1, "2", None, None), (2, 2, "x", None, None), (2, 28, None, None, 10), (3, 1, "3", None, None), (3, 2, "", None, None)]
    assert workbook.sheet_cells(book, 4) == [] == workbook.sheet_cells(book, 0)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("readme", "no workbook")
    files = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(other.getvalue())), ("c", bytearray(b"")), ("d", bytearray(b"%PDF-"))], "path string, content binary")
    assert {r["path"] for r in workbook.cells(files).collect()} == {"a"}


def test_fetching_goes_on(spark):
    def load():
        def ask(doi):
            if doi == "10.1/c":
                raise ConnectionError("down")
            return {"title": "T"} if doi == "10.1/a" else None

        return ask

    dois = spark.createDataFrame([("10.1/A",), ("10.1/a",), ("10.1/b",), ("10.1/c",), (None,)], "doi string")
    assert sorted((r["doi"], r["title"] or "") for r in spreadsheet.fetched(dois, load).collect()) == [("10.1/a", "T"), ("10.1/b", ""), ("10.1/c", "")]


def test_stores_replace_and_cache(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/s")
    grams = lambda *x: spark.createDataFrame(list(x), "doc_id string, chain_id int, head string, gram string, cnt bigint")
    store.replace("grams", grams(("1", 0, "h", "a", 1), ("2", 0, "h", "b", 1)), grams(("1", 0, "h", "a", 1), ("2", 0, "h", "b", 1)))
    store.replace("grams", spark.createDataFrame([("1",), ("3",)], "doc_id string"), grams(("3", 1, "k", "c", 4)))
    assert rows(store.read("grams")) == [("2", 0, "h", "b", 1), ("3", 1, "k", "c", 4)]
    sents = spark.createDataFrame([("1", 0, "x y"), ("1", 1, None), ("2", 0, "z")], "doc_id string, sentence_id int, text string")
    made = []

    def load():
        made.append(1)
        return models.hashed_words(8)

    store.embed(sents.where("doc_id = '1'"), "m", load)
    first = {tuple(r)[:2]: r["vector"] for r in store.vectors(sents, "m", load).collect()}
    assert set(first) == {("1", 0), ("1", 1), ("2", 0)} and store.read("embeddings").count() == 3
    assert {tuple(r)[:2]: r["vector"] for r in store.vectors(sents, "m", load).collect()} == first


def test_uploads_have_one_place(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b""))], "name string, content binary")
    for _ in range(2):
        got = {r["name"]: (r["path"], r["length"]) for r in tables.uploaded(files, f"file://{tmp_path}").collect()}
    assert got["a"] == got["b"] != got["c"] and got["c"][1] == 0
    assert spark.read.parquet(f"file://{tmp_path}/uploads").count() == 2


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        shared.shared_root(SimpleNamespace(conf=conf, sparkContext=context))
