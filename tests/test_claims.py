"""Claims against all sentences by the best of each task: the same as by joins, and sentences aren't shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import attribution
from lexloom.plans import registry


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e f g h i j k l m n".split())
    text = lambda n: " ".join(word() for _ in range(n))
    claims = spark.createDataFrame([(i, text(rng.randint(1, 9))) for i in range(12)] + [(12, "zz"), (13, ""), (14, None)], "claim_id long, text string")
    # Scores of 1/128 and 1/640 are halves of a millionth.
    odd = [(90, 0, "zz " + " ".join(f"w{i}" for i in range(127))), (90, 1, "zz " + " ".join(f"w{i}" for i in range(639))), (91, 0, "none of them"), (91, 1, "")]
    sents = spark.createDataFrame([(d, s, text(rng.randint(1, 12))) for d in range(40) for s in range(rng.randint(1, 6))] + odd, "doc_id long, sentence_id int, text string")
    return claims, sents.repartition(3, "doc_id").sortWithinPartitions("doc_id", "sentence_id")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def held(monkeypatch, most):
    monkeypatch.setattr(attribution, "CLAIM_WORDS", most)


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_best_of_each_task(both, monkeypatch, most):
    held(monkeypatch, most)
    claims, sents = both
    for k, least in ((3, 0.0), (2, 0.2), (4, 0.5)):
        want = attribution.supporting(attribution.word_scores(claims, sents), k, least)
        assert rows(attribution.best_supporting(claims, sents, k, least), *want.columns) == rows(want, *want.columns)
    want = attribution.reranked(attribution.candidates(claims, sents), 7, 4, 1)
    assert rows(attribution.reranked(attribution.best_candidates(claims, sents, 7), 7, 4, 1), *want.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("most", [1 << 18, 0])
@pytest.mark.parametrize("cells", [1 << 21, 15])
def test_capped_and_fused(both, monkeypatch, most, cells):
    held(monkeypatch, most)
    monkeypatch.setattr(attribution, "_CELLS", cells)
    claims, sents = both
    every = attribution.candidates(claims, sents)
    want = attribution.capped(every, ["ce", "dense"], 2)
    assert rows(attribution.capped_candidates(claims, sents, 2), *want.columns) == rows(want, *want.columns)
    first = lambda df: {(r["claim_id"], r["doc_id"], r["sentence_id"]): r["fused"] for r in df.collect()}
    want, got = first(attribution.z_fused(every, {"dense": 0.5, "ce": 0.5}, ["claim_id"], 4)), first(attribution.fused_candidates(claims, sents, 5))
    assert {k: want[k] for k in got} == got
    for c in range(13):
        best = sorted((-v, k) for k, v in want.items() if k[0] == c)[:5]
        assert {k for _, k in best} <= set(got)


SHUFFLES = {"f01_supporting": 1, "e07_attribution_statistics": 3, "i06_attribution": 3, "f07_z_fusion": 1, "f08_reranked": 2, "f09_per_document": 0, "h11_cross_scores": 2}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_sentences_stay_in_their_tasks(spark, sf, name):
    """Only the best of each task are dealt out: no exchange lies below the scoring but that of the documents' scan."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name], plan


def test_no_claims(both):
    claims, sents = both
    none = claims.where("claim_id < 0")
    assert attribution.best_supporting(none, sents).count() == attribution.fused_candidates(none, sents, 5).count() == attribution.capped_candidates(none, sents).count() == 0
    assert attribution.best_supporting(claims, sents.where(F.lit(False))).count() == 0
