"""Queries over tables, records, highlights, spreadsheets, tries and whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.scores import consensus
from lexloom.operators import corpus as O
from lexloom.operators import graph, highlights, intervals, models, spans, spreadsheet, tries
from lexloom.plans.index_queries import _GRID, _WM, word_mentions
from lexloom.plans.text_queries import _W
from lexloom.plans.vector_queries import _CE, _SP, _VEC, cluster_edges
from lexloom.plans.views import sentences, table, vectors, wide, with_
from lexloom.sources import corpus as S
from lexloom.sources import tables as D

C = F.col
STOP = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _files_for_dois(spark, sf) -> DataFrame:
    dois = table(spark, sf, "benchmark").select(F.concat(F.lit("10.1000/item."), C("item_id").cast("string"), F.lit("-x")).alias("doi"))
    names = _docs(spark, sf).select(F.concat(C("source"), F.lit("_10_1000_item_"), (C("doc_id") % 60).cast("string"), F.lit("_x_v"), C("doc_id").cast("string"), F.when(C("doc_id") % 2 == 0, ".pdf").otherwise(".doc")).alias("name"))
    return wide(S.files_for_dois(dois, names))


def _first_by_key(spark, sf) -> DataFrame:
    name = F.concat(C("lang"), F.lit("/Doi.org.doi.org.10.1..x"), (C("doc_id") % 50).cast("string"), F.lit(".PDF"))
    return wide(S.first_by_key(_docs(spark, sf).select(C("doc_id").alias("pos"), name.alias("name"))))


def _enriched(spark, sf) -> DataFrame:
    url = lambda k: F.concat(F.lit("https://doi.org/10.1016/J."), (C("doc_id") % k).cast("string"))
    rows = _docs(spark, sf).select("doc_id", F.when(C("doc_id") % 5 > 0, F.array(url(9), F.concat(F.lit("http://x.org/"), C("source")), url(400))).alias("all_urls"))
    bib = table(spark, sf, "benchmark").select(F.concat(F.lit("10.1016/j."), C("item_id").cast("string")).alias("doi"), F.concat(F.lit("T"), C("item_id").cast("string")).alias("title"))
    out = spreadsheet.enriched(rows, bib, "doc_id")
    return wide(out.select("doc_id", F.array_join("titles", "|").alias("titles"), F.array_join("other_urls", "|").alias("other_urls")))


def _assembled(spark, sf) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.when(C("doc_id") % 4 > 0, C("text")).alias("full_text"))
    chains = O.chains(O.chained(O.default_mentions(sentences(spark, sf))))
    out = D.assembled(docs, sentences(spark, sf), chains)
    return wide(out.select("doc_id", F.md5("full_text").alias("h"), F.coalesce(F.size("sentences"), F.lit(0)).alias("sents"), F.greatest(F.lit(0), F.coalesce(F.size("chains"), F.lit(0))).alias("chains")))


def _metadata(spark, sf) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.concat(F.lit(" a\\"), C("source")).alias("path"), C("lang").alias("title"), F.lit(None).cast("string").alias("year"))
    meta = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("a/src"), (C("item_id") % 15).cast("string")).alias("path"), F.concat(F.lit("t"), C("item_id").cast("string")).alias("title"), (C("item_id") + 1990).cast("string").alias("year"))
    return wide(D.with_metadata(rows, meta, "path", ["title", "year"], "item_id").select("doc_id", "title", "year"))


def _records(spark, sf) -> DataFrame:
    """Documents as nested records, one spelling for even ids and another for odd ones, flattened again."""
    s = sentences(spark, sf)
    cls = F.struct(F.when(C("doc_id") % 2 == 0, C("sentence_id")).alias("label"), F.when(C("doc_id") % 2 > 0, C("sentence_id")).alias("class_id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("consensus"))
    even = C("doc_id") % 2 == 0
    item = F.struct(C("sentence_id"), F.when(even, C("text")).alias("sentence_text"), F.when(~even, C("text")).alias("text"), F.when(even, C("start")).alias("doc_start"), F.when(even, C("end")).alias("doc_end"), F.when(~even, C("start")).alias("start"), F.when(~even, C("end")).alias("end"), cls.alias("classification"))
    rec = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", item.alias("i")))).alias("x")).select("doc_id", F.transform("x", lambda x: x["i"]).alias("sentence_analyses"))
    return wide(S.record_sentences(rec).select("doc_id", "sentence_id", "start", C("end").alias("stop"), F.md5("text").alias("h"), "label", "confidence"))


def _sheet(spark, sf) -> DataFrame:
    n = C("doc_id")
    rows = _docs(spark, sf).select("source", n, F.when(n % 7 == 0, F.concat(F.lit("Goal "), n.cast("string"))).when(n % 7 == 1, F.lit("  ")).alias("goal"), F.when(n % 3 > 0, F.concat(F.lit("t"), n.cast("string"))).otherwise("").alias("target"), F.concat(F.lit("see https://a.org/"), n.cast("string"), F.lit(", and (http://b.org/x). ")).alias("reference"))
    out = spreadsheet.flattened(rows, "doc_id", "goal", "target", "reference", ["source"])
    return wide(out.select("doc_id", "goal", "target", "extracted_url", F.size("all_urls").alias("n")))


def _graded(spark, sf) -> DataFrame:
    cells = _docs(spark, sf).select("doc_id", F.when(C("doc_id") % 3 == 0, F.lit("FF00C000")).when(C("doc_id") % 3 == 1, F.lit("FFFF8080")).alias("rgb"), (C("doc_id") % 11).cast("int").alias("theme"))
    return wide(spreadsheet.graded(cells).select("doc_id", "likert"))


def _boxes(spark, sf, step: int) -> DataFrame:
    n = C("doc_id")
    return _docs(spark, sf).select((n % 20).alias("doc_id"), (n % 3).cast("int").alias("page"), n.alias("pos"), (n % 11 * step).cast("double").alias("l"), (n % 5).cast("double").alias("t"), (n % 11 * step + 20).cast("double").alias("r"), (n % 5 + 10).cast("double").alias("b"))


def _covered(spark, sf) -> DataFrame:
    box = F.struct("l", "t", "r", "b").alias("bbox")
    a, b = _boxes(spark, sf, 2).select("doc_id", "page", "pos", box), _boxes(spark, sf, 3).where("pos % 4 = 0").select("doc_id", "page", box)
    return wide(highlights.uncovered(a, b).select("doc_id", "page", "pos"))


def _collected(spark, sf) -> DataFrame:
    n = C("doc_id")
    box = F.struct(F.lit(0.0).alias("l"), n.cast("double").alias("t"), F.lit(1.0).alias("r"), (n + 1).cast("double").alias("b"))
    rows = _docs(spark, sf).select("doc_id", F.lit(0).alias("sentence_id"), F.lit(1).alias("page"), (n % 10 / F.lit(10.0)).alias("confidence"), F.when(n % 3 == 0, box).alias("bbox"), F.when(n % 3 == 1, F.array(F.struct(box.alias("bbox")))).otherwise(F.array().cast("array<struct<bbox:struct<l:double,t:double,r:double,b:double>>>")).alias("spans"))
    return wide(highlights.collected(rows).select("doc_id", "sentence_id", "page", C("bbox.t").alias("t")))


def _sequences(spark, sf) -> DataFrame:
    """Phrases as made-up token ids: the lengths of their words."""
    return table(spark, sf, "benchmark").select("item_id", F.transform(T.words(C("text")), lambda w: F.length(w)).alias("ids"))


def _allowed(spark, sf) -> DataFrame:
    seq = _sequences(spark, sf)
    states = seq.select(C("item_id").alias("state_id"), F.array_join(F.slice("ids", F.lit(1), (C("item_id") % 8).cast("int")).cast("array<string>"), ",").alias("prefix"))
    return wide(tries.allowed(states, tries.prefixes(seq), tries.terminals(seq), 99).select("state_id", F.array_join(C("allowed").cast("array<string>"), ",").alias("allowed")))


def _chunked(spark, sf) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.explode(T.let(T.words(C("text")), lambda w: spans.chunks(w, 200, 128))).alias("c"))
    return wide(rows.select("doc_id", C("c.start").alias("first"), C("c.end").alias("last"), F.md5(F.array_join("c.words", " ")).alias("h")))


def _smoothed(spark, sf) -> DataFrame:
    tok = spans.token_importance(sentences(spark, sf))
    return wide(spans.smoothed(tok, ["doc_id", "sentence_id"], 3).select("doc_id", "sentence_id", "pos", F.round("smooth", 4).alias("smooth")))


def _keyphrases(spark, sf) -> DataFrame:
    """Start and end probabilities made of word lengths and places."""
    words = table(spark, sf, "benchmark").select(C("item_id").alias("doc_id"), F.posexplode(T.words(C("text"))).alias("pos", "word"))
    starts = words.select("doc_id", "pos", (F.length("word") % 10 / F.lit(10.0)).alias("p"))
    ends = words.select("doc_id", "pos", F.explode(F.sequence(C("pos"), C("pos") + 6)).alias("end_pos"))
    ends = ends.join(words.select("doc_id", C("pos").alias("end_pos"), (F.length("word") * 3 % 10 / F.lit(10.0)).alias("p")), ["doc_id", "end_pos"]).select("doc_id", "pos", "end_pos", "p")
    return wide(spans.keyphrases(starts, ends, words, STOP, 5).select("doc_id", "phrase", F.round("score", 6).alias("score")))


def _same_items(spark, sf) -> DataFrame:
    items = _docs(spark, sf).select("source", C("doc_id").alias("pos"), F.when(C("doc_id") % 2 == 0, F.upper("lang")).otherwise(C("lang")).alias("text"), (C("n_chars") % 100).alias("score"))
    return wide(spans.best_of_same(items, ["source"]).select("source", "key", "score", "place"))


def _span_pipeline(spark, sf) -> DataFrame:
    """Per sentence: consensus of two labels, best spans, and the chain that each maps to."""
    best = spans.ranked_runs(sentences(spark, sf).withColumn("s0", C("start")), k=2)
    at = best.select("doc_id", "sentence_id", "rank", (C("s0") + C("start")).alias("begin"), (C("s0") + C("end")).alias("stop"))
    mapped = intervals.with_chain(at, word_mentions(spark, sf))
    labels = table(spark, sf, "labels").select("doc_id", consensus(C("quality"), F.lit(0.7), C("toxic"), F.lit(0.6)).alias("consensus"))
    return wide(mapped.join(labels, "doc_id", "left").select("doc_id", "sentence_id", "rank", "begin", "stop", "chain_id", "consensus"))


def _evidence_chunks(spark, sf) -> DataFrame:
    claims = table(spark, sf, "benchmark").select(C("item_id").alias("claim_id"), "text")
    return wide(spans.chunk_evidence(_docs(spark, sf), claims, 100, 64).select("claim_id", "doc_id", C("start").alias("first"), C("end").alias("last"), "score").where("score > 0"))


QUERIES = {
    "a02_paged_text": lambda spark, sf: wide(S.paged_text(sentences(spark, sf).select(C("doc_id").alias("path"), (C("sentence_id") + 1).alias("page_no"), C("text").alias("cleaned"))).select("path", F.md5("text").alias("h"))),
    "a04_files_for_dois": _files_for_dois,
    "a05_sliced_files": lambda spark, sf: wide(S.sliced(sentences(spark, sf).select("doc_id", "sentence_id", "start", "end"), _docs(spark, sf)).select("doc_id", "sentence_id", F.md5("text").alias("h"))),
    "a06_graded_cells": _graded,
    "a10_enriched": _enriched,
    "a12_migrated": lambda spark, sf: wide(D.migrated(_docs(spark, sf).select("doc_id", C("text").alias("full_text")), D.SCHEMAS["documents"]).select("doc_id", "uri", "text_length")),
    "a19_assembled": _assembled,
    "a22_json_codec": lambda spark, sf: wide(vectors(spark, sf).select("id", F.from_json(F.to_json(F.struct("id", "label")), "id long, label int")["label"].alias("label"))),
    "a23_metadata": _metadata,
    "a26_first_by_key": _first_by_key,
    "a28_graph_metadata": lambda spark, sf: wide((lambda e: graph.metadata(e, graph.communities(vectors(spark, sf).select("id"), graph.sparsified(e, 0.55, 30), 1), vectors(spark, sf)))(cluster_edges(spark, sf).select("i", "j", "score"))),
    "b30_record_sentences": _records,
    "b32_terms": lambda spark, sf: wide(_docs(spark, sf).select("doc_id", F.size(T.term_words(T.words(C("text")))).alias("n"))),
    "c07_uncovered": _covered,
    "e11_merged_spans": lambda spark, sf: wide(spans.merged(_docs(spark, sf).select("source", (C("doc_id") % 7).alias("start"), (C("doc_id") % 7 + 3).alias("end"), (C("n_chars") % 50).cast("double").alias("importance")), ["source"]).select("source", "start", C("end").alias("stop"), "importance")),
    "e12_best_of_same": _same_items,
    "e13_counters": lambda spark, sf: wide(intervals.mention_sentences(word_mentions(spark, sf), sentences(spark, sf)).groupBy("doc_id", "sentence_id").agg(F.sum(F.size("spans")).alias("spans"), F.count(F.lit(1)).alias("chains"))),
    "e15_merged_boxes": lambda spark, sf: wide(highlights.merged(_boxes(spark, sf, 2))),
    "e16_collected": _collected,
    "e18_flattened": _sheet,
    "f12_first_of_same": lambda spark, sf: wide(spans.first_of_same(_docs(spark, sf).select("source", "lang", C("doc_id").alias("pos")), ["source", "lang"])),
    "f15_token_chunks": _chunked,
    "f16_sentence_windows": lambda spark, sf: wide(spans.sentence_windows(sentences(spark, sf)).select("doc_id", "window_id", C("first").alias("first_id"), C("last").alias("last_id"), F.md5("text").alias("h"))),
    "f18_smoothed": _smoothed,
    "f18_peaks": lambda spark, sf: wide(spans.peak_spans(sentences(spark, sf), spans.token_importance(sentences(spark, sf)), 2, 3, 5, 2).select("doc_id", "sentence_id", "start", C("end").alias("stop"), "score")),
    "h01_encoded": lambda spark, sf: wide(models.encoded(table(spark, sf, "benchmark"), "text", lambda: models.hashed_words(32)).select("item_id", F.size("vector").alias("dim"), F.round(F.aggregate(C("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))),
    "h08_keyphrases": _keyphrases,
    "h10_token_attribution": lambda spark, sf: wide(models.token_attribution(spans.token_importance(sentences(spark, sf)), ["doc_id", "sentence_id"]).select("doc_id", "sentence_id", "pos", F.round("weight", 6).alias("weight"))),
    "h12_packed_ids": lambda spark, sf: wide(models.packed_ids(sentences(spark, sf).select("doc_id", "sentence_id", F.transform(T.tokens(C("text")), lambda t: F.length(t) + 1000).alias("ids")), 101, 102, 512).select("doc_id", F.md5(F.array_join(C("ids").cast("array<string>"), ",")).alias("h"), F.size("cls_at").alias("sents"), F.aggregate("segments", F.lit(0), lambda a, x: a + x).alias("odd"))),
    "h13_prefixes": lambda spark, sf: wide(tries.prefixes(_sequences(spark, sf))),
    "h13_allowed": _allowed,
    "i01_span_pipeline": _span_pipeline,
    "i07_evidence_chunks": _evidence_chunks,
}

_SEQ = r"sq AS (SELECT item_id, list_transform(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM benchmark), px AS (SELECT DISTINCT array_to_string(ids[1:i - 1], ',') AS prefix, ids[i] AS next_token FROM (SELECT ids, generate_subscripts(ids, 1) AS i FROM sq))"
_BOX = "bx{0} AS (SELECT doc_id % 20 AS doc_id, doc_id % 3 AS page, doc_id AS pos, (doc_id % 11 * {0})::DOUBLE AS l, (doc_id % 5)::DOUBLE AS t, (doc_id % 11 * {0} + 20)::DOUBLE AS r, (doc_id % 5 + 10)::DOUBLE AS b FROM documents)"
_TOKW = r"wl AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM documents)"

ORACLE = {
    "a02_paged_text": with_("s") + "SELECT doc_id AS path, md5(string_agg('## Page ' || (sentence_id + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY sentence_id)) AS h FROM s GROUP BY doc_id",
    "a04_files_for_dois": """WITH d AS (SELECT '10.1000/item.' || item_id || '-x' AS doi FROM benchmark), v AS (SELECT doi, unnest([doi, replace(doi, '/', '_'), replace(doi, '/', '-'), replace(replace(doi, '.', '_'), '/', '_'), regexp_replace(doi, '[^0-9A-Za-z]+', '_', 'g'), split_part(doi, '/', 2)]) AS v FROM d),
  n AS (SELECT source || '_10_1000_item_' || (doc_id % 60) || '_x_v' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.doc' END AS name FROM documents) SELECT DISTINCT doi, name FROM v JOIN n ON contains(name, v) WHERE suffix(name, '.pdf')""",
    "a05_sliced_files": with_("s") + "SELECT doc_id, sentence_id, md5(trim(text)) AS h FROM s WHERE trim(text) <> ''",
    "a06_graded_cells": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN -2 ELSE CASE doc_id % 11 WHEN 9 THEN 5 WHEN 10 THEN -5 ELSE 0 END END::BIGINT AS likert FROM documents",
    "a10_enriched": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 9 IN (SELECT item_id FROM benchmark) THEN ['T' || doc_id % 9] ELSE [] END AS a, CASE WHEN doc_id % 5 > 0 AND doc_id % 400 IN (SELECT item_id FROM benchmark) THEN ['T' || doc_id % 400] ELSE [] END AS b, source FROM documents) SELECT doc_id, array_to_string(list_concat(a, b), '|') AS titles, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_concat(list_concat(CASE WHEN len(a) = 0 THEN ['https://doi.org/10.1016/J.' || doc_id % 9] ELSE [] END, ['http://x.org/' || source]), CASE WHEN len(b) = 0 THEN ['https://doi.org/10.1016/J.' || doc_id % 400] ELSE [] END), '|') END AS other_urls FROM t",
    "a12_migrated": "SELECT doc_id::VARCHAR AS doc_id, NULL::VARCHAR AS uri, length(text) AS text_length FROM documents",
    "a19_assembled": with_("s", "t", "m", "cc AS (SELECT doc_id, count(DISTINCT chain_id) AS chains FROM m GROUP BY doc_id), ss AS (SELECT doc_id, count(*) AS sents, string_agg(text, ' ' ORDER BY sentence_id) AS j FROM s GROUP BY doc_id)") + "SELECT d.doc_id, md5(CASE WHEN d.doc_id % 4 > 0 THEN text ELSE j END) AS h, coalesce(sents, 0) AS sents, coalesce(chains, 0) AS chains FROM documents d LEFT JOIN ss USING (doc_id) LEFT JOIN cc USING (doc_id)",
    "a22_json_codec": "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings",
    "a23_metadata": "WITH f AS (SELECT item_id % 15 AS k, min(item_id) AS i FROM benchmark GROUP BY 1) SELECT doc_id, coalesce('t' || i, lang) AS title, (i + 1990)::VARCHAR AS year FROM documents LEFT JOIN f ON source = 'src' || k",
    "a26_first_by_key": "SELECT '10.1.x' || doc_id % 50 AS key, min(doc_id) AS pos, (array_agg(lang || '/Doi.org.doi.org.10.1..x' || doc_id % 50 || '.PDF' ORDER BY doc_id))[1] AS name FROM documents GROUP BY doc_id % 50",
    "a28_graph_metadata": with_(_VEC, _CE, _SP.format(0.55, 30), "nb AS (SELECT i AS a, j AS b FROM sp UNION SELECT j, i FROM sp UNION SELECT id, id FROM e), l1 AS (SELECT a, min(b) AS c FROM nb GROUP BY a)") + "SELECT (SELECT count(*) FROM se) AS pairs_scored, (SELECT count(DISTINCT c) FROM l1) AS communities, (SELECT count(*) FROM e) AS nodes",
    "b30_record_sentences": with_("s") + "SELECT doc_id, sentence_id, start, stop, md5(text) AS h, sentence_id AS label, 0.5::DOUBLE AS confidence FROM s",
    "b32_terms": f"WITH {_TOKW} SELECT doc_id, len(list_filter(w, lambda x: NOT regexp_matches(x, '^\\[.*\\]$') AND NOT starts_with(x, '##') AND length(x) > 1 AND NOT regexp_matches(x, '^[\\p{{P}}\\p{{S}}]+$'))) AS n FROM wl",
    "c07_uncovered": f"WITH {_BOX.format(2)}, {_BOX.format(3)}, ov AS (SELECT a.pos FROM bx2 a JOIN bx3 c ON a.doc_id = c.doc_id AND a.page = c.page AND c.pos % 4 = 0 WHERE least(a.r, c.r) > greatest(a.l, c.l) AND least(a.b, c.b) > greatest(a.t, c.t) AND ((least(a.r, c.r) - greatest(a.l, c.l)) * (least(a.b, c.b) - greatest(a.t, c.t))) / (400 - (least(a.r, c.r) - greatest(a.l, c.l)) * (least(a.b, c.b) - greatest(a.t, c.t))) >= 0.85) SELECT doc_id, page, pos FROM bx2 WHERE pos NOT IN (SELECT pos FROM ov)",
    "e11_merged_spans": "SELECT source, doc_id % 7 AS start, doc_id % 7 + 3 AS stop, max(n_chars % 50)::DOUBLE AS importance FROM documents GROUP BY source, doc_id % 7",
    "e12_best_of_same": "SELECT source, lang AS key, max(n_chars % 100) AS score, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS place FROM documents GROUP BY source, lang",
    "e13_counters": with_("s", _W, _WM) + "SELECT wm.doc_id, sentence_id, count(*) AS spans, count(DISTINCT chain_id) AS chains FROM wm JOIN s ON wm.doc_id = s.doc_id AND s.start <= wm.start AND wm.stop <= s.stop GROUP BY ALL",
    "e15_merged_boxes": f"""WITH RECURSIVE {_BOX.format(2)}, ls AS (SELECT doc_id, page, list({{'l': l, 't': t, 'r': r, 'b': b}} ORDER BY pos) AS x FROM bx2 GROUP BY doc_id, page),
  st(doc_id, page, x, i, o) AS (SELECT doc_id, page, x, 1, x[1:0] FROM ls UNION ALL SELECT doc_id, page, x, i + 1, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(o, y) ELSE list_transform(o, lambda z, j: CASE WHEN j = hit THEN {{'l': least(z.l, y.l), 't': least(z.t, y.t), 'r': greatest(z.r, y.r), 'b': greatest(z.b, y.b)}} ELSE z END) END FROM (
    SELECT *, list_position(list_transform(o, lambda z: least(z.r, y.r) > greatest(z.l, y.l) AND least(z.b, y.b) > greatest(z.t, y.t) AND (least(z.r, y.r) - greatest(z.l, y.l)) * (least(z.b, y.b) - greatest(z.t, y.t)) / ((z.r - z.l) * (z.b - z.t) + (y.r - y.l) * (y.b - y.t) - (least(z.r, y.r) - greatest(z.l, y.l)) * (least(z.b, y.b) - greatest(z.t, y.t))) >= 0.6), true) AS hit FROM (SELECT *, x[i] AS y FROM st WHERE i <= len(x))))
SELECT doc_id, page, u.l, u.t, u.r, u.b FROM (SELECT doc_id, page, unnest(o) AS u FROM st WHERE i = len(x) + 1)""",
    "e16_collected": "SELECT doc_id, 0::BIGINT AS sentence_id, 1::BIGINT AS page, doc_id::DOUBLE AS t FROM documents WHERE doc_id % 10 >= 7 AND doc_id % 3 < 2",
    "e18_flattened": "WITH g AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'Goal ' || doc_id END AS goal FROM documents), f AS (SELECT doc_id, last_value(goal IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS goal FROM g) SELECT doc_id, goal, 't' || doc_id AS target, 'https://a.org/' || doc_id AS extracted_url, 2::BIGINT AS n FROM f WHERE doc_id % 3 > 0",
    "f12_first_of_same": "SELECT source, lang, min(doc_id) AS pos FROM documents GROUP BY source, lang",
    "f15_token_chunks": f"WITH {_TOKW}, c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 128.0))::BIGINT + 1)) * 128 AS first FROM wl WHERE len(w) > 0) SELECT doc_id, first, least(first + 200, len(w)) AS last, md5(array_to_string(w[first + 1:first + 200], ' ')) AS h FROM c",
    "f16_sentence_windows": with_("s", "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM s)") + "SELECT a.doc_id, a.i // 2 AS window_id, min(b.sentence_id) AS first_id, max(b.sentence_id) AS last_id, md5(string_agg(b.text, ' ' ORDER BY b.sentence_id)) AS h FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 2 WHERE a.i % 2 = 0 GROUP BY a.doc_id, a.i",
    # Words are apart, so a span around a peak is that word alone.
    "f18_peaks": with_("s", _W, "ht AS (SELECT doc_id, sentence_id, pos, start, stop, CASE WHEN count(*) OVER (PARTITION BY doc_id, sentence_id) = 2 THEN round(sum(length(word)) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos) / 3.0::DOUBLE, 6) ELSE round(sum(length(word)) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE, 6) END AS h FROM w)",
        "pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY h DESC, pos) AS k FROM ht WHERE h > 0) WHERE k <= 6 AND stop - start >= 5)",
        "gi AS (SELECT *, sum(CASE WHEN start - prev <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sentence_id ORDER BY start) AS grp FROM (SELECT *, lag(stop) OVER (PARTITION BY doc_id, sentence_id ORDER BY start) AS prev FROM pk))",
        "mg AS (SELECT doc_id, sentence_id, min(start) AS start, max(stop) AS stop, round(sum(h * (stop - start)), 6) AS score FROM gi GROUP BY doc_id, sentence_id, grp)")
    + "SELECT doc_id, sentence_id, start, stop, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY score DESC, start) AS k FROM mg) WHERE k <= 2",
    "f18_smoothed": with_("s", _W) + "SELECT doc_id, sentence_id, pos, round(round(sum(length(word)) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE, 6), 4) AS smooth FROM w",
    "h01_encoded": "SELECT item_id, 32::BIGINT AS dim, CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM benchmark",
    "h08_keyphrases": r"""WITH wl AS (SELECT item_id AS doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM benchmark), wd AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM wl),
  p AS (SELECT a.doc_id, a.pos, b.pos AS end_pos, round(length(a.word) % 10 / 10.0::DOUBLE * (length(b.word) * 3 % 10 / 10.0::DOUBLE), 9) AS score, w[a.pos + 1:b.pos + 1] AS t FROM wd a JOIN wd b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 4 JOIN wl ON wl.doc_id = a.doc_id WHERE length(a.word) % 10 >= 1),
  q AS (SELECT *, array_to_string(t, ' ') AS phrase FROM p WHERE length(trim(array_to_string(t, ' '))) > 2 AND len(list_filter(t, lambda x: x NOT IN ("""
    + ", ".join(f"'{w}'" for w in STOP)
    + r"""))) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, end_pos) AS k FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(phrase)) ORDER BY pos) AS o FROM k WHERE k = 1 AND score > 0.1) SELECT doc_id, phrase, round(score, 6) AS score FROM o WHERE o = 1""",
    "h10_token_attribution": with_("s", _W) + "SELECT doc_id, sentence_id, pos, round(round(length(word)::DOUBLE / sum(length(word)) OVER (PARTITION BY doc_id, sentence_id), 9), 6) AS weight FROM w",
    "h12_packed_ids": with_("s", "t", "k AS (SELECT doc_id, sentence_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS i, list_concat(list_concat([101], list_transform(ts, lambda x: length(x) + 1000)), [102]) AS ids FROM tl), f AS (SELECT doc_id, flatten(list(ids ORDER BY i))[1:512] AS ids, flatten(list(list_transform(ids, lambda x: i % 2) ORDER BY i))[1:512] AS sg FROM k GROUP BY doc_id)") + "SELECT doc_id, md5(array_to_string(ids, ',')) AS h, len(list_filter(ids, lambda x: x = 101)) AS sents, list_sum(sg)::BIGINT AS odd FROM f",
    "h13_prefixes": f"WITH {_SEQ} SELECT prefix, next_token FROM px",
    "h13_allowed": f"WITH {_SEQ}, st AS (SELECT item_id AS state_id, array_to_string(ids[1:item_id % 8], ',') AS prefix FROM sq), nx AS (SELECT prefix, string_agg(next_token::VARCHAR, ',' ORDER BY next_token) AS a FROM px GROUP BY prefix), en AS (SELECT DISTINCT array_to_string(ids, ',') AS prefix FROM sq WHERE len(ids) > 0) SELECT state_id, coalesce(a, CASE WHEN en.prefix IS NOT NULL THEN '99' ELSE '' END) AS allowed FROM st LEFT JOIN nx USING (prefix) LEFT JOIN en USING (prefix)",
    "i01_span_pipeline": with_("s", _W, _WM, "e AS (SELECT a.doc_id, a.sentence_id, a.start, b.stop FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND b.pos BETWEEN a.pos AND a.pos + 3), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY stop - start DESC, start, stop) AS rank FROM e), a AS (SELECT k.doc_id, k.sentence_id, rank, s.start + k.start AS begin, s.start + k.stop AS stop FROM k JOIN s USING (doc_id, sentence_id) WHERE rank <= 2), pb AS (SELECT *, unnest([begin, (begin + stop) // 2, greatest(begin, stop - 1)]) AS point FROM a), hh AS (SELECT pb.doc_id, sentence_id, rank, min(chain_id) AS chain_id FROM pb JOIN wm ON wm.doc_id = pb.doc_id AND point >= wm.start AND point < wm.stop GROUP BY ALL)") + "SELECT a.doc_id, a.sentence_id, a.rank, begin, a.stop, chain_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = toxic THEN 'agreement' ELSE CASE WHEN abs(0.7::DOUBLE - 0.6::DOUBLE) >= 0.1 THEN 'disagreement' ELSE 'bert_only' END END AS consensus FROM a LEFT JOIN hh ON hh.doc_id = a.doc_id AND hh.sentence_id = a.sentence_id AND hh.rank = a.rank LEFT JOIN labels l ON l.doc_id = a.doc_id",
    "i07_evidence_chunks": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws, string_split_regex(text, '[^ \t\n\x0B\f\r]+') AS gs FROM documents),
  w1 AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM d), w AS (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS stop FROM w1),
  c AS (SELECT *, greatest(0, ceil((n - 100) / 64.0))::BIGINT AS last FROM w),
  k AS (SELECT doc_id, chunk, min(stop - length(word)) AS first, max(stop) AS last, list_distinct(list_filter(flatten(list(string_split_regex(lower(word), '[ \t\n\r\f]+'))), lambda x: x <> '')) AS ws FROM (SELECT *, unnest(range(greatest(0, ceil((pos - 99) / 64.0))::BIGINT, least(last, pos // 64) + 1)) AS chunk FROM c) GROUP BY doc_id, chunk),
  x AS (SELECT doc_id, first, last, len(ws) AS n, unnest(ws) AS word FROM k),
  cl AS (SELECT item_id AS claim_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS ws FROM benchmark), cw AS (SELECT claim_id, len(ws) AS m, unnest(ws) AS word FROM cl)
SELECT claim_id, doc_id, first, last, round(count(*)::DOUBLE / (n + m - count(*)), 6) AS score FROM x JOIN cw USING (word) GROUP BY claim_id, doc_id, first, last, n, m""",
}
assert _GRID
