"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import mixing
from lexloom.llm.common import stored
from tests.llm.test_edges import WORD, docs, reachable


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Documents before each stage, and the result of the last."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), f"test-{name}"))
    return [x.toPandas() for x in out]


def fold(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def test_stages_keep_the_columns(stages):
    for x in stages[:-1]:
        assert list(x.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (x["n_chars"] == x["text"].str.len()).all()


def test_rules(stages):
    def passes(text):
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    kept = dict(zip(stages[1]["doc_id"], stages[1]["text"]))
    # No line of so small a table is in more than 20 documents of a host.
    assert kept == {i: t for i, t in zip(stages[0]["doc_id"], stages[0]["text"]) if passes(t)}


def test_lines(stages):
    first: dict[str, int] = {}
    holders = collections.defaultdict(set)
    for i, t in sorted(zip(stages[1]["doc_id"], stages[1]["text"])):
        for line in t.split("\n"):
            if len(fold(line)) >= 10:
                first.setdefault(fold(line), i)
                holders[fold(line)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders.get(fold(x), ())) < 2 or first[fold(x)] == i) for i, t in zip(stages[1]["doc_id"], stages[1]["text"])}
    assert dict(zip(stages[2]["doc_id"], stages[2]["text"])) == want


def test_near(stages):
    component = reachable(list(zip(stages[2]["doc_id"], stages[2]["text"])), 80)
    assert sorted(stages[3]["doc_id"]) == sorted(i for i, c in component.items() if i == c)


def test_mixing(spark, stages):
    sizes = {i: (s, len(WORD.findall(t))) for i, t, s in zip(stages[3]["doc_id"], stages[3]["text"], stages[3]["source"])}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.values()], "source string, size long")
    budget = {r["source"]: r["budget"] for r in mixing.source_targets(rows, (5, 2, 1), 3).collect()}
    took = collections.Counter()
    texts = dict(zip(stages[3]["doc_id"], stages[3]["text"]))
    for i, t, s in zip(stages[4]["doc_id"], stages[4]["text"], stages[4]["source"]):
        assert texts[i].startswith(t)
        took[s] += len(WORD.findall(t))
    assert took == budget
    cut = sum(t != texts[i] for i, t in zip(stages[4]["doc_id"], stages[4]["text"]))
    assert cut <= len(budget)


def test_packing(stages):
    packed = stages[5].sort_values(["sequence_id", "offset"])
    assert (packed["offset"] == packed.groupby("sequence_id")["length"].cumsum() - packed["length"]).all()
    full = packed.groupby("sequence_id")["length"].sum()
    assert full.max() <= 4096 and len(full) <= -(-full.sum() // 4096) + 1
    assert collections.Counter(packed[packed["piece"] == 0]["doc_id"]) == collections.Counter(stages[4]["doc_id"])


def test_run_is_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[5][["doc_id", "piece", "length", "ids_crc32"]].itertuples(index=False)))


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None), (2, "", "a"), (None, "one two three four five six seven eight nine ten", "a"), (3, "one two three four five six seven eight nine ten", "a"), (3, "one two three four five six seven eight nine ten", "a")]
    for name, df in (("odd", docs(spark, *rows)), ("none", docs(spark))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.agg(F.count(F.lit(1))).first()[0] == (3 if name == "odd" else 0)


def test_mixing_of_equal_rows(spark):
    same = (1, "one two three four five six seven", "a")
    rows = [same] * 9 + [(i, " ".join(f"w{i}x{j}" for j in range(i)), "b") for i in range(2, 40)] + [(99, "p q r", "c")] * 4 + [(100, None, "c"), (None, "x y", None)]
    df = docs(spark, *rows)
    sizes = spark.createDataFrame([(s, len(WORD.findall(t or ""))) for _, t, s in rows], "source string, size long")
    budget = {r["source"]: r["budget"] for r in mixing.source_targets(sizes, (5, 2, 1), 3).collect()}
    out = mixing.mixed_documents(df)
    took = collections.Counter()
    for r in out.collect():
        took[r["source"]] += len(WORD.findall(r["text"]))
    assert out.columns == df.columns and took == budget
    assert mixing.mixed_documents(docs(spark)).count() == 0
