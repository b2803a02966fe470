"""What is made within a row, and what is dealt out by document once."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import coref, intervals, spans
from lexloom.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mentions_that_spell_a_pronoun_by_their_plain_letters(spark):
    """b16, e10: 'ñh eñññññ' has the letters of 'he', but is a mention of its own."""
    m = spark.createDataFrame([(1, 1, 0, 0, "ñh eñññññ"), (1, 1, 1, 0, "a b"), (1, 2, 0, 0, "(It)"), (1, 2, 1, 0, "x")], "doc_id long, chain_id int, sentence_id int, pos int, text string")
    assert rows(coref.representative_of(m, ["doc_id", "chain_id"], F.struct("sentence_id", "pos"))) == [(1, 1, "ñh eñññññ"), (1, 2, "x")]
    got = coref.keyphrase_clusters(m, ["doc_id", "chain_id"]).select("chain_id", "mentions")
    assert rows(got) == [(1, ["a b", "ñh eñññññ"])]
    assert spark.range(1).select(T.is_pronoun_mention(F.lit(None).cast("string")), T.is_pronoun_mention(F.lit(" them,")), T.is_pronoun_mention(F.lit("the m"))).first()[:] == (False, True, False)


def test_best_runs(spark):
    texts = ["a bb  ccc dddd e", "", " ", "one", None, "aa bb aa bb aa bb aa", "é ñññ — x"]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sentence_id int, text string")
    for most, k in ((4, 8), (3, 2), (1, 3)):
        keys = ["doc_id", "sentence_id"]
        want = spans.ranked(spans.merged(spans.enumerated(s, most), keys), keys, k)
        assert rows(spans.ranked_runs(s, most, k).select(*want.columns)) == rows(want)


def test_with_chain(spark):
    at = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 21), (2, 0, 5, 5), (3, 0, 0, 4)], "doc_id long, span_id int, begin int, stop int")
    m = spark.createDataFrame([(1, 7, 4, 6), (1, 3, 9, 12), (1, 1, 1, 4), (2, 2, 5, 6), (1, 9, 30, 40)], "doc_id long, chain_id int, start int, end int")
    want = at.join(intervals.span_to_chain(at, m), ["doc_id", "span_id"]).select("doc_id", "span_id", "begin", "stop", "chain_id")
    assert rows(intervals.with_chain(at, m)) == rows(want)


@pytest.mark.parametrize(("name", "most"), [("f03_ranked_spans", 0), ("h07_span_candidates", 0), ("i01_span_pipeline", 4)])
def test_shuffles(spark, sf, name, most):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan
