"""Queries over vectors, pairs, graphs and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import predicates as P
from lexloom.functions.scores import cosine
from lexloom.operators import attribution, concordance, graph, models, simjoin, vectors as V
from lexloom.operators.grams import top
from lexloom.plans.text_queries import _jac, _ratio
from lexloom.plans.views import sentences, table, vectors, wide, with_
from lexloom.sources.shared import stored

C = F.col


def claims(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(C("item_id").alias("claim_id"), "text")


def word_scores(spark, sf, least: float = 0.0) -> DataFrame:
    return attribution.word_scores(claims(spark, sf), sentences(spark, sf), least)


def supporting(spark, sf, k: int, least: float) -> DataFrame:
    return attribution.best_supporting(claims(spark, sf), sentences(spark, sf), k, least)


def queries(spark, sf) -> DataFrame:
    return vectors(spark, sf).where("id % 50 = 0").select(C("id").alias("query_id"), "vector")


def label_vectors(spark, sf) -> DataFrame:
    """The first vector of each label stands for it."""
    first = vectors(spark, sf).groupBy("label").agg(F.min("id").alias("code"))
    return vectors(spark, sf).join(first.select("code"), C("id") == C("code")).select("code", "vector")


def ordered(spark, sf) -> DataFrame:
    """Vectors as the sentences of ten documents."""
    return vectors(spark, sf).select(C("label").alias("doc_id"), C("id").alias("sentence_id"), "vector")


def cluster_edges(spark, sf) -> DataFrame:
    members = vectors(spark, sf).select(C("label").alias("cluster_id"), "id", "vector")
    return graph.similarity_edges(members)


def numbered(spark, sf) -> DataFrame:
    """All sentences (doc_id, id, text), with one number for document and place."""
    return sentences(spark, sf).select("doc_id", (C("doc_id") * 1_000_000 + C("sentence_id")).alias("id"), "text")


def lines(spark, sf) -> DataFrame:
    """Sentences as sets of character shingles."""
    return numbered(spark, sf).select("id", simjoin.char_shingles(C("text")).alias("items"))


def alike(spark, sf) -> DataFrame:
    """Pairs of different sentences that are alike as lines() are, whose shingles are made where they are compared, and copies."""
    return simjoin.text_pairs(numbered(spark, sf).select("id", "text"), 0.8, 5)


def _banded_shortlist(spark, sf) -> DataFrame:
    """D14 without vectors: sentences near each other, and those that are alike."""
    s = numbered(spark, sf)
    same = stored(simjoin.text_pairs(s.select("id", "text"), 0.8, 5, where=P.cheaply_alike).select("i", "j"), "alike", small=True)
    return wide(simjoin.near_texts(s, ["doc_id"], 2, P.cheaply_alike).unionByName(same).distinct())


def _shortlist(spark, sf) -> DataFrame:
    """Pairs of sentences whose vectors are near, by an index of cells, and of those that are alike.

    Of sentences with one text the first stands for all: the rest are its copies in the second source.
    """
    s = numbered(spark, sf).select("id", "text")
    same = stored(simjoin.jaccard_pairs(s, 0.8, runs=5).select("i", "j"), "alike", small=True)
    first = stored(models.encoded(s.groupBy("text").agg(F.min("id").alias("id")), "text", lambda: models.hashed_words(64)).select("id", "vector"), "vectors", small=True)
    n = first.count()
    index, centres = V.cell_index(first, max(2, min(4096, round(n**0.5))))
    near = V.probe(index, centres, first.select(C("id").alias("query_id"), "vector"), 10, 4)
    pairs = stored(near.select(F.least("query_id", "id").alias("i"), F.greatest("query_id", "id").alias("j")), "near", small=True)
    return wide(simjoin.shortlist(s, [pairs, same], 0.25, 0.08))


def _communities(spark, sf) -> DataFrame:
    e = cluster_edges(spark, sf).select("i", "j", "score")
    nodes = vectors(spark, sf).select("id")
    return wide(graph.communities(nodes, graph.sparsified(e, 0.55, 30), 2))


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Supervisors of a made-up hierarchy: the parent of n is n div 3."""
    n = vectors(spark, sf).where("id > 0").select((C("id") / 3).cast("long").alias("parent"), C("id").alias("child"))
    return n, spark.range(0, 3).select(C("id").alias("node"))


def _chain_trees(spark, sf, roots: bool) -> DataFrame:
    n, _ = _tree(spark, sf)
    edges = n.withColumn("label", F.when(C("child") % 4 == 0, "corefer").otherwise("parent"))
    members = vectors(spark, sf).select((C("id") % 2).alias("chain_id"), C("id").alias("node")).union(vectors(spark, sf).select(F.lit(2).cast("long"), "id"))
    inside, top_ = graph.chain_trees(edges, members)
    return wide(top_ if roots else inside)


def _summary(spark, sf) -> DataFrame:
    m = vectors(spark, sf).select(C("label").alias("group_id"), "id", "vector")
    return wide(graph.group_summary(m, 0.0, 3, 5).select("group_id", "representative", F.array_join(F.transform("kept", lambda x: x["id"].cast("string")), ",").alias("kept")))


def _vector_concordance(spark, sf) -> DataFrame:
    q = vectors(spark, sf).where("id = 7").first()["vector"]
    rows = vectors(spark, sf).select(C("label").alias("doc_id"), C("id").alias("sentence_id"), "vector")
    return wide(concordance.vector(rows, list(q), 20).select("doc_id", "sentence_id", "score", "rank"))


def _joined_embeddings(spark, sf) -> DataFrame:
    """Vectors with their sentences, and the documents' sources where there are any."""
    e = vectors(spark, sf).select(C("id").alias("doc_id"), F.lit(0).alias("sentence_id"), F.size("vector").alias("dim"))
    d = table(spark, sf, "documents").where("doc_id % 3 > 0").select("doc_id", "source")
    return wide(e.join(sentences(spark, sf).select("doc_id", "sentence_id", F.length("text").alias("n")), ["doc_id", "sentence_id"]).join(d, "doc_id", "left"))


def _ranked_hits(spark, sf) -> DataFrame:
    """Ranked hits with their sentences; hits without one go, and ranks keep their gaps."""
    hits = top(table(spark, sf, "documents").select("doc_id", (C("n_chars") % 4).cast("int").alias("sentence_id"), "n_chars"), [F.desc("n_chars"), C("doc_id")], 100)
    return wide(hits.join(sentences(spark, sf).select("doc_id", "sentence_id", F.length("text").alias("n")), ["doc_id", "sentence_id"]).select("doc_id", "sentence_id", "rank", "n"))


def _soft_match(spark, sf) -> DataFrame:
    """Names matched exactly, and those without a match by suffix."""
    want = table(spark, sf, "documents").select(F.when(C("doc_id") % 2 == 0, C("source")).otherwise(F.substring("source", 3, 10)).alias("name")).distinct()
    have = table(spark, sf, "documents").select("source").distinct()
    exact = want.join(have, C("name") == C("source"))
    # Names by their last characters: what is looked for is a suffix, so its hash meets those of all suffixes.
    suffixes = have.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.substring(C("source"), i, F.length("source")))).alias("suffix"))
    soft = want.join(exact.select("name"), "name", "left_anti").join(suffixes, C("name") == C("suffix")).groupBy("name").agg(F.min("source").alias("source"))
    return exact.unionByName(soft)


def _upsert(spark, sf) -> DataFrame:
    from lexloom.sources.tables import upserted

    old = table(spark, sf, "documents").select("doc_id", "n_chars", F.lit(0).alias("version"))
    new = table(spark, sf, "labels").select((C("doc_id") * 2).alias("doc_id"), (C("quality") + 10).cast("long").alias("n_chars"), F.lit(1).alias("version"))
    return wide(upserted(old, new, ["doc_id"]))


_VEC = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_WS = r"""cw AS (SELECT item_id AS claim_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '')) AS w FROM benchmark),
  sw AS (SELECT doc_id, sentence_id, text, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '')) AS w FROM s),
  cx AS (SELECT claim_id, len(w) AS nc, unnest(w) AS word FROM cw), sx AS (SELECT doc_id, sentence_id, len(w) AS ns, unnest(w) AS word FROM sw),
  ws AS (SELECT claim_id, doc_id, sentence_id, round(count(*)::DOUBLE / (nc + ns - count(*)), 6) AS score FROM sx JOIN cx USING (word) GROUP BY claim_id, doc_id, sentence_id, nc, ns)"""
_STAGE = f"st AS (SELECT claim_id, ws.doc_id, ws.sentence_id, score AS dense, round({_ratio('b.text', 's.text')}, 6) AS ce, length(s.text) % 10 / 10.0::DOUBLE AS ig FROM ws JOIN benchmark b ON b.item_id = claim_id JOIN s ON s.doc_id = ws.doc_id AND s.sentence_id = ws.sentence_id)"
_SUP = "su AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id, sentence_id) AS rank FROM ws WHERE score >= {0})"
_KNN = "kn AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)"
_CE = "ce AS (SELECT a.label AS cluster_id, a.id AS i, b.id AS j, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.id < b.id), se AS (SELECT * FROM ce WHERE score > 0.1)"
_SP = "sp AS (SELECT i, j, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i, j) AS k FROM (SELECT i, j, score, unnest([i, j]) AS q FROM se WHERE score >= {0})) WHERE k <= {1} GROUP BY i, j, score HAVING count(*) = 2)"
_MEAN = "pl AS (SELECT label, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM e), mp AS (SELECT label, p, avg(x) AS x FROM pl GROUP BY label, p), me AS (SELECT label, list(x ORDER BY p) AS c FROM mp GROUP BY label), si AS (SELECT e.label, id, round(list_cosine_similarity(v, c), {0}) AS sim FROM e JOIN me ON e.label = me.label)"
_SH = "CASE WHEN length({0}) >= 5 THEN list_distinct(list_transform(range(1, length({0}) - 3), lambda i: substr({0}, i, 5))) ELSE [{0}] END"
_FS = f"""fa AS (SELECT doc_id * 1000000 + sentence_id AS id, text, list_sort({_SH.format('lower(text)')}) AS items FROM s), fr AS (SELECT *, min(id) OVER (PARTITION BY text) AS rep FROM fa), fs AS (SELECT id, items, len(items) AS n FROM fr WHERE id = rep),
  it AS (SELECT id, n, unnest(items) AS item FROM fs), fd AS (SELECT item, count(*) AS df FROM it GROUP BY item), rk AS (SELECT id, n, item, df, row_number() OVER (PARTITION BY id ORDER BY df, item) AS k FROM it JOIN fd USING (item)), pf AS (SELECT id, n, item FROM rk WHERE df > 1 AND k <= n - ceil(n * 0.8 - 1e-9) + 1),
  cp AS (SELECT DISTINCT a.id AS i, b.id AS j FROM pf a JOIN pf b ON a.item = b.item AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
  jp AS (SELECT i, j, round(len(list_intersect(a.items, b.items))::DOUBLE / (a.n + b.n - len(list_intersect(a.items, b.items))), 6) AS score FROM cp JOIN fs a ON a.id = i JOIN fs b ON b.id = j UNION ALL SELECT rep, id, 1.0 FROM fr WHERE id <> rep)"""

QUERIES = {
    "f01_supporting": lambda spark, sf: wide(supporting(spark, sf, 3, 0.1)),
    "e07_attribution_statistics": lambda spark, sf: wide(attribution.statistics(claims(spark, sf), supporting(spark, sf, 3, 0.1))),
    "i06_attribution": lambda spark, sf: wide(attribution.attribute(claims(spark, sf), table(spark, sf, "documents"), 2, 0.2)[0].select("claim_id", "evidence_count", F.coalesce(F.get("evidence", 0)["similarity"], F.lit(0.0)).alias("best"), F.get("evidence", 0)["strength"].alias("strength"))),
    "f02_top_k": lambda spark, sf: wide(top(word_scores(spark, sf), [F.desc("score"), C("claim_id"), C("doc_id"), C("sentence_id")], 50)),
    "f07_z_fusion": lambda spark, sf: wide(top(attribution.fused_candidates(claims(spark, sf), sentences(spark, sf), 5), [F.desc("fused"), C("doc_id"), C("sentence_id")], 5, ["claim_id"]).select("claim_id", "fused", "rank")),
    "f08_reranked": lambda spark, sf: wide(attribution.reranked(attribution.best_candidates(claims(spark, sf), sentences(spark, sf), 100)).select("claim_id", "doc_id", "sentence_id", "dense", "ce", "ig")),
    "f09_per_document": lambda spark, sf: wide(attribution.capped_candidates(claims(spark, sf), sentences(spark, sf), 2).select("claim_id", "doc_id", "sentence_id", "k")),
    "f14_semantic_chunks": lambda spark, sf: wide(attribution.semantic_chunks(ordered(spark, sf), least=0.05)),
    "g03_nearest": lambda spark, sf: wide(V.nearest(queries(spark, sf), vectors(spark, sf), 5)),
    "g01_cells": lambda spark, sf: wide((lambda i: V.probe(i[0], i[1], queries(spark, sf), 5, 8))(V.cell_index(vectors(spark, sf), 22)).select("query_id", "rank", "id", "score")),
    "g02_unit": lambda spark, sf: wide(V.unit(vectors(spark, sf)).select("id", F.round(C("vector")[0], 6).alias("x"), F.round(C("vector")[63], 6).alias("y"))),
    "g04_vector_concordance": _vector_concordance,
    "g06_minhash_exact": lambda spark, sf: wide(alike(spark, sf)),
    "g06_minhash_bands": lambda spark, sf: wide(simjoin.minhash_pairs(numbered(spark, sf).select("id", "text"), 0.8, runs=5)),
    "d14_shortlist": _shortlist,
    "d14_banded": _banded_shortlist,
    "g08_similarity_graph": lambda spark, sf: wide(cluster_edges(spark, sf)),
    "g11_sparsified": lambda spark, sf: wide(graph.sparsified(cluster_edges(spark, sf).select("i", "j", "score"), 0.2, 5)),
    "g11_communities": _communities,
    "g12_group_summary": _summary,
    "g13_extractive_summary": lambda spark, sf: wide(graph.extractive_summary(vectors(spark, sf).select(C("label").alias("group_id"), "id", F.concat(F.lit("v"), C("id").cast("string")).alias("text"), "vector"), 4)),
    "g14_descendants": lambda spark, sf: wide(graph.descendants(*_tree(spark, sf))),
    "d15_chain_edges": lambda spark, sf: _chain_trees(spark, sf, False),
    "d15_chain_roots": lambda spark, sf: _chain_trees(spark, sf, True),
    "d01_embedding_join": _joined_embeddings,
    "d02_sentence_document": lambda spark, sf: wide(sentences(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))),
    "d03_ranked_hits": _ranked_hits,
    "d13_soft_match": _soft_match,
    "h02_argmax": lambda spark, sf: wide(vectors(spark, sf).select("id", models.argmax_label(C("vector").cast("array<double>")).alias("x")).select("id", "x.*")),
    "h03_nearest_label": lambda spark, sf: wide(models.nearest_label(vectors(spark, sf).select("id", "vector"), label_vectors(spark, sf), 0.3)),
    "a13_upsert": _upsert,
    "f11_set_operations": lambda spark, sf: wide((lambda a, b: a.intersect(b).withColumn("op", F.lit("and")).union(a.union(b).distinct().withColumn("op", F.lit("or"))))(table(spark, sf, "documents").where("lang = 'fr'").select("source"), table(spark, sf, "documents").where("doc_id % 7 = 0").select("source"))),
    "f10_ordered_documents": lambda spark, sf: wide(table(spark, sf, "documents").select("doc_id", F.when(C("doc_id") % 3 > 0, C("source")).alias("stamp")).orderBy(F.desc(F.coalesce("stamp", F.lit(""))), "doc_id").limit(25)),
    "e19_distinct_models": lambda spark, sf: table(spark, sf, "documents").select(C("lang").alias("model")).distinct(),
}

ORACLE = {
    "f01_supporting": with_("s", _WS, _SUP.format(0.1)) + "SELECT *, CASE WHEN score >= 0.8 THEN 'Very Strong' WHEN score >= 0.6 THEN 'Strong' WHEN score >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength FROM su WHERE rank <= 3",
    "e07_attribution_statistics": with_("s", _WS, _SUP.format(0.1)) + "SELECT round(count(DISTINCT claim_id)::DOUBLE / (SELECT count(*) FROM benchmark), 6) AS coverage, coalesce(round(avg(score), 6), 0.0) AS avg_similarity, count(DISTINCT doc_id) AS sources_used, count(*) AS total_evidence, count(*) FILTER (WHERE score >= 0.6) AS strong_attributions, count(*) FILTER (WHERE score < 0.4) AS weak_attributions FROM su WHERE rank <= 3",
    "i06_attribution": with_("s", _WS, _SUP.format(0.2), "be AS (SELECT claim_id, count(*) AS evidence_count, max(score) AS best FROM su WHERE rank <= 2 GROUP BY claim_id)") + "SELECT item_id AS claim_id, coalesce(evidence_count, 0) AS evidence_count, coalesce(best, 0.0) AS best, CASE WHEN best >= 0.8 THEN 'Very Strong' WHEN best >= 0.6 THEN 'Strong' WHEN best >= 0.4 THEN 'Moderate' WHEN best IS NOT NULL THEN 'Weak' END AS strength FROM benchmark LEFT JOIN be ON claim_id = item_id",
    "f02_top_k": with_("s", _WS) + "SELECT *, row_number() OVER (ORDER BY score DESC, claim_id, doc_id, sentence_id) AS rank FROM ws ORDER BY rank LIMIT 50",
    "f07_z_fusion": with_("s", _WS, _STAGE, "zf AS (SELECT *, round(0.5 * (dense - avg(dense) OVER p) / (stddev_pop(dense) OVER p + 1e-8) + 0.5 * (ce - avg(ce) OVER p) / (stddev_pop(ce) OVER p + 1e-8), 4) AS fused FROM st WINDOW p AS (PARTITION BY claim_id))") + "SELECT claim_id, fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY fused DESC, doc_id, sentence_id) AS rank FROM zf) WHERE rank <= 5",
    "f08_reranked": with_("s", _WS, _STAGE, "r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY dense DESC, doc_id, sentence_id) AS k1 FROM st) WHERE k1 <= 100), r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ce DESC, doc_id, sentence_id) AS k2 FROM r1) WHERE k2 <= 20)") + "SELECT claim_id, doc_id, sentence_id, dense, ce, ig FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY ig DESC, ce DESC, dense DESC, sentence_id) AS k3 FROM r2) WHERE k3 = 1",
    "f09_per_document": with_("s", _WS, _STAGE) + "SELECT * FROM (SELECT claim_id, doc_id, sentence_id, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY ce DESC, dense DESC, sentence_id) AS k FROM st) WHERE k <= 2",
    "f14_semantic_chunks": with_(_VEC, "o AS (SELECT label AS doc_id, id AS sentence_id, v, lag(v) OVER (PARTITION BY label ORDER BY id) AS pv, count(*) OVER (PARTITION BY label) AS n FROM e)", "k AS (SELECT *, sum(CASE WHEN n > 2 AND pv IS NOT NULL AND round(list_cosine_similarity(pv, v), 6) <= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sentence_id) AS chunk_id FROM o)") + "SELECT doc_id::BIGINT AS doc_id, chunk_id::BIGINT AS chunk_id, min(sentence_id) AS first, max(sentence_id) AS last, count(*) AS n FROM k GROUP BY ALL",
    "g03_nearest": with_(_VEC, _KNN) + "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM kn) WHERE rank <= 5",
    "g02_unit": with_(_VEC) + "SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS y FROM e",
    "g04_vector_concordance": with_(_VEC) + "SELECT label::BIGINT AS doc_id, id AS sentence_id, score, row_number() OVER (ORDER BY score DESC, label, id) AS rank FROM (SELECT b.label, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id = 7) ORDER BY rank LIMIT 20",
    "g06_minhash_exact": with_("s", _FS) + "SELECT * FROM jp WHERE score >= 0.8",
    "d14_banded": with_("s", _FS, "nb AS (SELECT a.doc_id * 1000000 + a.sentence_id AS i, b.doc_id * 1000000 + b.sentence_id AS j FROM (SELECT doc_id, sentence_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) AS r FROM s) a JOIN (SELECT doc_id, sentence_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) AS r FROM s) b ON a.doc_id = b.doc_id AND b.r - a.r BETWEEN 1 AND 2), pr AS (SELECT i, j FROM nb UNION SELECT i, j FROM jp WHERE score >= 0.8), tx AS (SELECT doc_id * 1000000 + sentence_id AS id, text FROM s), px AS (SELECT i, j, a.text AS x, b.text AS y FROM pr JOIN tx a ON a.id = i JOIN tx b ON b.id = j)") + f"SELECT i, j FROM px WHERE {_ratio('x', 'y')} >= 0.25 AND {_jac('x', 'y')} >= 0.08",
    "g08_similarity_graph": with_(_VEC, _CE) + "SELECT cluster_id::BIGINT AS cluster_id, i, j, score FROM se",
    "g11_sparsified": with_(_VEC, _CE, _SP.format(0.2, 5)) + "SELECT i, j, score FROM sp",
    "g11_communities": with_(_VEC, _CE, _SP.format(0.55, 30), "nb AS (SELECT i AS a, j AS b FROM sp UNION SELECT j, i FROM sp UNION SELECT id, id FROM e), v1 AS (SELECT a, b AS c, count(*) AS n FROM nb GROUP BY ALL), l1 AS (SELECT a AS id, (array_agg(c ORDER BY n DESC, c))[1] AS c FROM v1 GROUP BY a), v2 AS (SELECT a, c, count(*) AS n FROM nb JOIN l1 ON l1.id = b GROUP BY ALL)") + "SELECT a AS id, (array_agg(c ORDER BY n DESC, c))[1] AS community FROM v2 GROUP BY a",
    "g12_group_summary": with_(_VEC, _MEAN.format(5), "rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS k FROM si)") + "SELECT label::BIGINT AS group_id, min(id) FILTER (WHERE k = 1) AS representative, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3 AND sim >= 0), '') AS kept FROM rk GROUP BY label",
    "g13_extractive_summary": with_(_VEC, _MEAN.format(6), "rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS k FROM si)") + "SELECT label::BIGINT AS group_id, string_agg('v' || id, '. ' ORDER BY id) AS summary FROM rk WHERE k <= 4 GROUP BY label",
    "g14_descendants": "WITH RECURSIVE ed AS (SELECT vec_id // 3 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 0), d(root, node, level) AS (SELECT i, i, 0::BIGINT FROM range(0, 3) t(i) UNION SELECT root, child, level + 1 FROM d JOIN ed ON parent = node WHERE level < 20) SELECT root, node, min(level) AS level FROM d GROUP BY ALL",
    "d15_chain_edges": "WITH ed AS (SELECT vec_id // 3 AS parent, vec_id AS child, CASE WHEN vec_id % 4 = 0 THEN 'corefer' ELSE 'parent' END AS label FROM embeddings WHERE vec_id > 0), me AS (SELECT vec_id % 2 AS chain_id, vec_id AS node FROM embeddings UNION SELECT 2, vec_id FROM embeddings) SELECT a.chain_id, parent, child, label FROM ed JOIN me a ON a.node = parent JOIN me b ON b.node = child AND a.chain_id = b.chain_id",
    "d15_chain_roots": "WITH ed AS (SELECT vec_id // 3 AS parent, vec_id AS child, CASE WHEN vec_id % 4 = 0 THEN 'corefer' ELSE 'parent' END AS label FROM embeddings WHERE vec_id > 0), me AS (SELECT vec_id % 2 AS chain_id, vec_id AS node FROM embeddings UNION SELECT 2, vec_id FROM embeddings), r AS (SELECT DISTINCT a.chain_id, child AS node FROM ed JOIN me a ON a.node = parent JOIN me b ON b.node = child AND a.chain_id = b.chain_id WHERE label <> 'corefer'), f AS (SELECT * FROM me EXCEPT SELECT * FROM r) SELECT * FROM f UNION ALL SELECT * FROM me WHERE chain_id NOT IN (SELECT chain_id FROM f)",
    "d01_embedding_join": with_("s") + "SELECT s.doc_id, s.sentence_id, len(embedding)::BIGINT AS dim, length(s.text) AS n, d.source FROM embeddings JOIN s ON s.doc_id = vec_id AND s.sentence_id = 0 LEFT JOIN documents d ON d.doc_id = vec_id AND d.doc_id % 3 > 0",
    "d02_sentence_document": with_("s") + "SELECT quality::BIGINT AS quality, count(*) AS n FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id GROUP BY quality",
    "d03_ranked_hits": with_("s", "h AS (SELECT doc_id, n_chars % 4 AS sentence_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)") + "SELECT s.doc_id, s.sentence_id, rank, length(text) AS n FROM h JOIN s USING (doc_id, sentence_id) WHERE rank <= 100",
    "d13_soft_match": "WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE substr(source, 3, 10) END AS name FROM documents), h AS (SELECT DISTINCT source FROM documents) SELECT name, source FROM w JOIN h ON name = source UNION ALL SELECT name, min(source) FROM w JOIN h ON suffix(source, name) WHERE name NOT IN (SELECT source FROM h) GROUP BY name",
    "h02_argmax": with_(_VEC) + "SELECT id, list_position(v, list_max(v))::BIGINT - 1 AS label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS confidence FROM e",
    "h03_nearest_label": with_(_VEC, "nl AS (SELECT a.id, b.id AS code, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE b.id IN (SELECT min(id) FROM e GROUP BY label)), bl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS k FROM nl)") + "SELECT id, CASE WHEN score >= 0.3 THEN code END AS label, score FROM bl WHERE k = 1",
    "a13_upsert": "SELECT doc_id * 2 AS doc_id, quality::BIGINT + 10 AS n_chars, 1::BIGINT AS version FROM labels UNION ALL SELECT doc_id, n_chars, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)",
    "f11_set_operations": "WITH a AS (SELECT source FROM documents WHERE lang = 'fr'), b AS (SELECT source FROM documents WHERE doc_id % 7 = 0) SELECT source, 'and' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT source, 'or' FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "f10_ordered_documents": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS stamp FROM documents ORDER BY coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') DESC, doc_id LIMIT 25",
    "e19_distinct_models": "SELECT DISTINCT lang AS model FROM documents",
}
