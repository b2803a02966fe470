"""Queries over n-gram and co-occurrence indices, intervals and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import cooc, coref, corpus, grams, intervals, spans
from lexloom.plans.text_queries import _PK, _PRON, _W
from lexloom.plans.views import mentions, sentences, table, wide, with_
from lexloom.sources.shared import stored

C = F.col
CHAIN = ["doc_id", "chain_id", "head"]


def mention_grams() -> Column:
    """The tokens of a mention joined, its head, and the character 4-grams of its text."""
    return F.concat(F.array(F.concat_ws(T.GRAM_JOIN, "prev", "head"), C("head")), T.character_runs(C("text"), 4))


def index(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The gram index and the chains, of mentions that are made once and stored."""
    return indexed(stored(mentions(spark, sf), "mentions"))


def indexed(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stored(grams.counted(m, mention_grams(), CHAIN), "grams"), m.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("n_mentions"))


def probes(m: DataFrame, n: int = 1) -> DataFrame:
    """The mentions that most documents hold: (query_id, prev, head, text)."""
    found = m.groupBy("text", "prev", "head").agg(F.count_distinct("doc_id").alias("docs"))
    return grams.top(found, [F.desc("docs"), C("text")], n, rank="query_id").select("query_id", "prev", "head", "text")


def phrase_scores(spark, sf, n: int = 1) -> DataFrame:
    """(query_id, doc_id, chain_id, head, score) of all chains that share a gram with a probe."""
    m = stored(mentions(spark, sf), "mentions")
    return scored_phrases(probes(m, n), *indexed(m))


def scored_phrases(asked: DataFrame, idx: DataFrame, chains: DataFrame) -> DataFrame:
    """phrase_scores() of phrases (query_id, prev, head, text), from a stored index."""
    idf = grams.global_idf(idx, chains)
    q = asked.select("query_id", F.explode(F.array_distinct(mention_grams())).alias("gram"))
    weigh = lambda rows: grams.weighted(rows, idf, 1.0, ["gram"])
    return grams.jaccard_shortlist(weigh(stored(q, "asked")), idx, CHAIN, weigh)


def flagship(spark, sf) -> DataFrame:
    """Corpus-wide phrase lookup: the ten chains most like the most widespread mention."""
    kept = grams.pruned(phrase_scores(spark, sf), 0.18, strict=False)
    return wide(kept.select("doc_id", "head", "score").orderBy(F.desc("score"), "doc_id", "head").limit(10))


def _local(spark, sf) -> DataFrame:
    """E03, local: chains of each document against the document's most frequent chain."""
    idx, chains = index(spark, sf)
    idf = grams.local_idf(idx, chains)
    w = grams.weighted(idx, idf, 0.0, ["doc_id", "gram"])
    lead = chains.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_mentions"), "head"))).where("k = 1").select("doc_id", "chain_id")
    q = w.join(lead, ["doc_id", "chain_id"]).select(C("doc_id").alias("query_id"), "gram", "w")
    # The document is part of the gram, so that chains meet the query of their own document alone.
    tag = lambda df, d: df.withColumn("gram", F.concat_ws("|", C(d).cast("string"), "gram"))
    return wide(grams.pruned(grams.jaccard_shortlist(tag(q, "query_id"), tag(w, "doc_id"), CHAIN), 0.18, strict=True).select("doc_id", "chain_id", "score"))


def _postings(spark, sf) -> DataFrame:
    m = stored(mentions(spark, sf), "mentions")
    hits = indexed(m)[0].join(probes(m).select(F.explode(F.array_distinct(mention_grams())).alias("gram")), "gram")
    return wide(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("chains"), F.sum("cnt").alias("mentions")))


def edges(spark, sf) -> DataFrame:
    return cooc.ppmi_edges(corpus.document_tokens(table(spark, sf, "documents")))


def lexicon(m: DataFrame) -> DataFrame:
    return m.select("doc_id", "chain_id", F.explode(F.array("prev", "head")).alias("token")).distinct()


def chain_vectors(spark, sf) -> DataFrame:
    """(doc_id, chain_id, col_tok, v)."""
    return cooc.vectors(lexicon(mentions(spark, sf)), edges(spark, sf), ["doc_id", "chain_id"])


def chain_cosines(spark, sf) -> DataFrame:
    # As decimals, so that the order in which products are added doesn't show.
    v = stored(chain_vectors(spark, sf).withColumn("v", F.round("v", 6).cast("decimal(9,6)")), "chain-vectors")
    first = v.where("chain_id = 1").select("doc_id", "col_tok", "v")
    return cooc.sparse_cosine(first, v.where("chain_id > 1"), ["doc_id"], ["doc_id", "chain_id"]).withColumn("score", C("score").cast("double"))


def _fusion(spark, sf) -> DataFrame:
    """of each document's chains, likeness to chain 1 by grams and by co-occurrence."""
    idx, chains = index(spark, sf)
    w = grams.weighted(idx, grams.local_idf(idx, chains), 0.0, ["doc_id", "gram"])
    tag = lambda df, d: df.withColumn("gram", F.concat_ws("|", C(d).cast("string"), "gram"))
    q = w.where("chain_id = 1").select(C("doc_id").alias("query_id"), "gram", "w")
    a = grams.jaccard_shortlist(tag(q, "query_id"), tag(w.where("chain_id > 1"), "doc_id"), CHAIN).select("doc_id", "chain_id", "score")
    out = grams.fused(a, chain_cosines(spark, sf), ["doc_id", "chain_id"])
    return wide(grams.top(out, [F.desc("score"), C("chain_id")], 5, ["doc_id"]).select("doc_id", "chain_id", "score", "why", "rank"))


# --- intervals ------------------------------------------------------------------------------------------------------------
def grid(spark, sf, step: int, size: int) -> DataFrame:
    """Spans of a size at every step of each document."""
    at = F.explode(F.sequence(F.lit(0), C("n_chars").cast("int"), F.lit(step)))
    d = table(spark, sf, "documents").select("doc_id", at.alias("begin"))
    return d.select("doc_id", "begin", (C("begin") + size).alias("stop"), (C("begin") / step).cast("int").alias("span_id"))


def word_mentions(spark, sf) -> DataFrame:
    """Words of ten characters or more as mentions: (doc_id, chain_id, start, end, text), a chain for each word."""
    rows = sentences(spark, sf).select("doc_id", "start", F.explode(spans.located_words(C("text"))).alias("w"))
    rows = rows.select("doc_id", (C("start") + C("w.start")).alias("start"), (C("start") + C("w.end")).alias("end"), C("w.word").alias("text")).where(F.length("text") >= 10)
    return rows.withColumn("chain_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.lower("text"))))


def _first_words(spark, sf) -> DataFrame:
    """The first words of a document's sentences as one chain."""
    rows = sentences(spark, sf).select("doc_id", "sentence_id", F.split("text", " ")[0].alias("text"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_id")) - 1)


def _resolved(spark, sf) -> DataFrame:
    """D03, B17 with chains: pronouns of sentences replaced by the longest word of their document."""
    words = sentences(spark, sf).select("doc_id", "start", F.explode(spans.located_words(C("text"))).alias("w"))
    m = words.select("doc_id", (C("start") + C("w.start")).alias("start"), (C("start") + C("w.end")).alias("end"), C("w.word").alias("text"))
    rep = m.groupBy("doc_id").agg(F.min(F.struct((-F.length("text")).alias("n"), "text"))["text"].alias("representative"))
    out = coref.resolved_sentences(sentences(spark, sf), m.join(rep, "doc_id"))
    return wide(out.select("doc_id", "sentence_id", F.length("text").alias("n")))


QUERIES = {
    "flagship_phrase_lookup": flagship,
    "e01_local_idf": lambda spark, sf: wide((lambda i: grams.local_idf(*i))(index(spark, sf)).select("doc_id", "gram", "df", F.round("idf", 6).alias("idf"))),
    "e02_global_idf": lambda spark, sf: wide((lambda i: grams.global_idf(*i))(index(spark, sf)).select("gram", "df", F.round("idf", 6).alias("idf"))),
    "e03_weighted_jaccard": lambda spark, sf: wide(phrase_scores(spark, sf, 3).drop("query_id").groupBy("doc_id", "head").agg(F.max("score").alias("score"))),
    "f04_local_shortlist": _local,
    "f06_global_query": lambda spark, sf: wide(grams.top(grams.pruned(phrase_scores(spark, sf, 3), 0.18, strict=True), [F.desc("score"), C("doc_id"), C("head")], 10, ["query_id"]).select("query_id", "doc_id", "head", "score", "rank")),
    "e14_phrases_and": lambda spark, sf: wide(grams.by_phrases(phrase_scores(spark, sf, 2), CHAIN, 2, True).select("doc_id", "head", "score")),
    "e14_phrases_or": lambda spark, sf: wide(grams.by_phrases(phrase_scores(spark, sf, 2), CHAIN, 2, False).select("doc_id", "head", "score")),
    "d11_postings": _postings,
    "e04_ppmi": lambda spark, sf: wide(edges(spark, sf)),
    "e04_norms": lambda spark, sf: wide(cooc.row_norms(edges(spark, sf), 4)),
    "e05_chain_vectors": lambda spark, sf: wide(chain_vectors(spark, sf).select("doc_id", "chain_id", "col_tok", F.round("v", 6).alias("v"))),
    "e06_chain_cosine": lambda spark, sf: wide(chain_cosines(spark, sf).select("doc_id", "chain_id", "score")),
    "f05_fusion": _fusion,
    "e17_hits_by_document": lambda spark, sf: wide(phrase_scores(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))),
    "d05_stab": lambda spark, sf: wide(intervals.stabbing(grid(spark, sf, 50, 1).select("doc_id", C("begin").alias("point")), sentences(spark, sf)).select("doc_id", "point", "sentence_id")),
    "d05_stab_bucketed": lambda spark, sf: wide(intervals.stabbing(grid(spark, sf, 50, 1).select("doc_id", C("begin").alias("point")), sentences(spark, sf), bucket=256).select("doc_id", "point", "sentence_id")),
    "d06_overlap": lambda spark, sf: wide(intervals.overlapping(grid(spark, sf, 100, 60), sentences(spark, sf)).select("doc_id", "begin", "sentence_id")),
    "d07_containment": lambda spark, sf: wide(intervals.containing(grid(spark, sf, 40, 10), sentences(spark, sf), ["doc_id", "begin"], [C("sentence_id")]).select("doc_id", "begin", "sentence_id")),
    "d08_span_to_chain": lambda spark, sf: wide(intervals.span_to_chain(grid(spark, sf, 100, 30), word_mentions(spark, sf))),
    "d08_related": lambda spark, sf: wide(intervals.related_mentions(grid(spark, sf, 100, 30).join(intervals.span_to_chain(grid(spark, sf, 100, 30), word_mentions(spark, sf)).where("chain_id is not null"), ["doc_id", "span_id"]), word_mentions(spark, sf)).select("doc_id", "span_id", "start", "k")),
    "d09_mention_sentences": lambda spark, sf: wide(intervals.mention_sentences(word_mentions(spark, sf), sentences(spark, sf)).select("doc_id", "chain_id", "sentence_id", F.size("spans").alias("n"), C("spans")[0]["start"].alias("first"))),
    "d12_best_overlap": lambda spark, sf: wide(intervals.best_overlap(grid(spark, sf, 90, 70).withColumn("score", (C("span_id") * 7 % 11) / F.lit(10.0)), sentences(spark, sf), 200).select("doc_id", "sentence_id", "score", "overlap")),
    "d16_mention_buckets": lambda spark, sf: wide(intervals.bucketed_mentions(word_mentions(spark, sf).select("doc_id", "chain_id", "start", "end", F.when(C("start") % 7 == 0, -1).cast("int").alias("sentence_id")), sentences(spark, sf))),
    "h04_chains": lambda spark, sf: wide(corpus.chains(mentions(spark, sf))),
    "b16_representative": lambda spark, sf: wide(coref.representative_of(mentions(spark, sf), ["doc_id", "chain_id"], F.struct("sentence_id", "pos"))),
    "f13_antecedents": lambda spark, sf: wide(coref.antecedents(_first_words(spark, sf), ["doc_id"])),
    "e09_tag_histogram": lambda spark, sf: wide(coref.tag_histogram(coref.antecedents(_first_words(spark, sf), ["doc_id"]), ["doc_id"])),
    "e08_chain_statistics": lambda spark, sf: wide((lambda m: coref.statistics(m, coref.antecedents(m, ["doc_id"]), ["doc_id"]))(_first_words(spark, sf)).select("doc_id", "mentions", "sentences", "name", F.coalesce(F.element_at("tags", F.lit("OTHER")), F.lit(0)).alias("other"))),
    "e10_keyphrase_clusters": lambda spark, sf: wide(coref.keyphrase_clusters(mentions(spark, sf).select("doc_id", "chain_id", "text", "sentence_id"), ["doc_id", "chain_id"]).select("doc_id", "chain_id", F.size("mentions").alias("n"), F.size("sentences").alias("sents"), F.element_at("mentions", 1).alias("first"))),
    "g09_clusters_by_mention": lambda spark, sf: wide(coref.clusters_by_mention(mentions(spark, sf)).select("doc_id", "chain_id", F.array_join(C("members").cast("array<string>"), ",").alias("members"))),
    "g10_clusters_by_seed": lambda spark, sf: wide(coref.clusters_by_seed(sentences(spark, sf).select("doc_id", "sentence_id").join(mentions(spark, sf).select("doc_id", "sentence_id", "chain_id").distinct(), ["doc_id", "sentence_id"], "left")).select("doc_id", "cluster_id", F.array_join(C("members").cast("array<string>"), ",").alias("members"))),
    "d10_touching": lambda spark, sf: wide(coref.touching(mentions(spark, sf), 499, 0)),
    "b17_pronouns_resolved": _resolved,
    "a21_index_sizes": lambda spark, sf: wide(__import__("lexloom.sources.tables", fromlist=["index_sizes"]).index_sizes(index(spark, sf)[0], 20)),
}

_IDF = """n AS (SELECT count(*) AS n FROM ch), df AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
  idf AS (SELECT gram, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df, n)"""
_LIDF = """ln0 AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id), ldf AS (SELECT doc_id, gram, count(*) AS df FROM g GROUP BY ALL),
  lidf AS (SELECT doc_id, gram, df, ln((n + 1) / (df + 0.5)::DOUBLE) AS idf FROM ldf JOIN ln0 USING (doc_id))"""


def _probe(n: int) -> str:
    return f"""pr AS (SELECT row_number() OVER (ORDER BY docs DESC, text) AS query_id, prev, head, text FROM (SELECT text, prev, head, count(DISTINCT doc_id) AS docs FROM m GROUP BY ALL) ORDER BY docs DESC, text LIMIT {n}),
  q AS (SELECT query_id, gram, coalesce(idf, 1.0) AS w FROM (SELECT query_id, unnest(list_distinct(list_concat([prev || '§' || head, head], list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))))) AS gram FROM pr) LEFT JOIN idf USING (gram)),
  qm AS (SELECT query_id, sum(w) AS qm FROM q GROUP BY query_id), cm AS (SELECT doc_id, chain_id, head, sum(idf) AS cm FROM g JOIN idf USING (gram) GROUP BY ALL),
  b AS (SELECT query_id, doc_id, chain_id, g.head, sum(w) AS b FROM g JOIN q USING (gram) GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, chain_id, b.head, round(b / (qm + cm - b), 6) AS score FROM b JOIN qm USING (query_id) JOIN cm USING (doc_id, chain_id))"""


_G = ("s", "t", "m", "g")
_COOC = r"""dt0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents),
  dt AS (SELECT doc_id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM dt0),
  kt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS n FROM dt) WHERE n >= 2),
  pa AS (SELECT a.doc_id, a.token AS x, b.token AS y FROM (SELECT doc_id, token, i, unnest(range(1, 6)) AS k FROM kt) a JOIN kt b ON a.doc_id = b.doc_id AND b.i = a.i + a.k),
  cc AS (SELECT doc_id, r AS row_tok, c AS col_tok, count(*) AS c FROM (SELECT doc_id, x AS r, y AS c FROM pa UNION ALL SELECT doc_id, y, x FROM pa) GROUP BY doc_id, r, c),
  rs AS (SELECT doc_id, row_tok, sum(c) AS s FROM cc GROUP BY ALL), tt AS (SELECT doc_id, sum(s) AS total FROM rs GROUP BY doc_id),
  pp AS (SELECT cc.doc_id, cc.row_tok, cc.col_tok, round(ln((c * total)::DOUBLE / (a.s::DOUBLE * b.s) + 1e-12), 6) AS ppmi FROM cc JOIN rs a ON a.doc_id = cc.doc_id AND a.row_tok = cc.row_tok JOIN rs b ON b.doc_id = cc.doc_id AND b.row_tok = cc.col_tok JOIN tt ON tt.doc_id = cc.doc_id),
  ed AS (SELECT doc_id, row_tok, col_tok, ppmi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row_tok ORDER BY ppmi DESC, col_tok) AS k FROM pp WHERE ppmi > 0) WHERE k <= 10)"""
_COS = """lx AS (SELECT DISTINCT doc_id, chain_id, unnest([prev, head]) AS token FROM m),
  v0 AS (SELECT lx.doc_id, chain_id, col_tok, sum(ppmi) AS x FROM lx JOIN ed ON ed.doc_id = lx.doc_id AND ed.row_tok = lx.token GROUP BY ALL),
  v AS (SELECT doc_id, chain_id, col_tok, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, chain_id)), 6)::DECIMAL(9,6) AS v FROM v0),
  cs AS (SELECT b.doc_id, b.chain_id, round(sum(a.v * b.v), 6)::DOUBLE AS score FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.col_tok = b.col_tok WHERE a.chain_id = 1 AND b.chain_id > 1 GROUP BY ALL)"""
_LSC = """lw AS (SELECT g.*, coalesce(idf, 0.0) AS w FROM g LEFT JOIN lidf USING (doc_id, gram)), lm AS (SELECT doc_id, chain_id, sum(w) AS mass FROM lw GROUP BY ALL),
  lb AS (SELECT c.doc_id, c.chain_id, l.chain_id AS lead, sum(l.w) AS b FROM lw c JOIN lw l ON c.doc_id = l.doc_id AND c.gram = l.gram JOIN ld ON ld.doc_id = l.doc_id AND ld.chain_id = l.chain_id GROUP BY ALL),
  ls AS (SELECT lb.doc_id, lb.chain_id, round(CASE WHEN a.mass + c.mass - b > 0 THEN b / (a.mass + c.mass - b) ELSE 0.0 END, 6) AS score FROM lb JOIN lm a ON a.doc_id = lb.doc_id AND a.chain_id = lb.lead JOIN lm c ON c.doc_id = lb.doc_id AND c.chain_id = lb.chain_id)"""
_GRID = "gr{0} AS (SELECT doc_id, unnest(range(0, n_chars + 1, {0})) AS begin FROM documents)"
_WM = """wm AS (SELECT doc_id, start, stop, word, dense_rank() OVER (PARTITION BY doc_id ORDER BY lower(word)) AS chain_id FROM (SELECT w.doc_id, s.start + w.start AS start, s.start + w.stop AS stop, word FROM w JOIN s USING (doc_id, sentence_id) WHERE length(word) >= 10))"""
_S2C = """sp AS (SELECT doc_id, begin, begin // 100 AS span_id, unnest([begin, begin + 15, begin + 29]) AS point FROM gr100),
  hit AS (SELECT sp.doc_id, span_id, min(chain_id) AS chain_id FROM sp JOIN wm ON sp.doc_id = wm.doc_id AND point >= start AND point < stop GROUP BY ALL),
  sc2 AS (SELECT gr100.doc_id, begin, begin // 100 AS span_id, chain_id FROM gr100 LEFT JOIN hit ON hit.doc_id = gr100.doc_id AND hit.span_id = begin // 100)"""
_ANTE = f"""fw AS (SELECT doc_id, sentence_id, split_part(text, ' ', 1) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS idx FROM s),
  fp AS (SELECT *, {_PK.format('text')} IN ({_PRON}) AS pron, {_PK.format('text')} AS pk FROM fw),
  fa AS (SELECT *, last_value(CASE WHEN NOT pron AND idx >= 1 THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM fp),
  fe AS (SELECT b.doc_id, a.idx AS antecedent, b.idx AS anaphor, trim(a.text) AS x, trim(b.text) AS y, a.pron AS px, b.pron AS py, a.pk AS kx, b.pk AS ky FROM fa b JOIN fp a ON a.doc_id = b.doc_id AND a.idx = coalesce(b.l, b.idx - 1) WHERE b.idx >= 1),
  an AS (SELECT doc_id, antecedent, anaphor, CASE WHEN px AND py AND kx = ky THEN 'PRON-PRON-C' WHEN px AND py THEN 'PRON-PRON-NC' WHEN x <> '' AND x = y THEN 'MATCH' WHEN x <> '' AND y <> '' AND (contains(y, x) OR contains(x, y)) THEN 'CONTAINS' WHEN NOT px AND py THEN 'ENT-PRON' ELSE 'OTHER' END AS tag FROM fe)"""

ORACLE = {
    "flagship_phrase_lookup": with_(*_G, _IDF, _probe(1)) + "SELECT doc_id, head, score FROM sc WHERE score >= 0.18 OR (SELECT max(score) FROM sc) < 0.18 ORDER BY score DESC, doc_id, head LIMIT 10",
    "e01_local_idf": with_(*_G, _LIDF) + "SELECT doc_id, gram, df, round(idf, 6) AS idf FROM lidf",
    "e02_global_idf": with_(*_G, _IDF) + "SELECT gram, df, round(idf, 6) AS idf FROM idf",
    "e03_weighted_jaccard": with_(*_G, _IDF, _probe(3)) + "SELECT doc_id, head, max(score) AS score FROM sc GROUP BY ALL",
    "f04_local_shortlist": with_(*_G, _LIDF, "ld AS (SELECT doc_id, chain_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_mentions DESC, head) AS k FROM ch) WHERE k = 1)", _LSC) + "SELECT * FROM ls WHERE score >= 0.18",
    "f06_global_query": with_(*_G, _IDF, _probe(3)) + "SELECT * FROM (SELECT query_id, doc_id, head, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, head) AS rank FROM sc WHERE score >= 0.18) WHERE rank <= 10",
    "e14_phrases_and": with_(*_G, _IDF, _probe(2)) + "SELECT doc_id, head, min(score) AS score FROM sc GROUP BY doc_id, chain_id, head HAVING count(DISTINCT query_id) = 2",
    "e14_phrases_or": with_(*_G, _IDF, _probe(2)) + "SELECT doc_id, head, max(score) AS score FROM sc GROUP BY doc_id, chain_id, head",
    "d11_postings": with_(*_G, _IDF, _probe(1)) + "SELECT gram, count(*) AS chains, sum(cnt)::BIGINT AS mentions FROM g JOIN q USING (gram) GROUP BY gram",
    "e04_ppmi": with_(_COOC) + "SELECT * FROM ed",
    "e04_norms": with_(_COOC) + "SELECT doc_id, row_tok, round(sqrt(sum(ppmi * ppmi)), 4) AS norm FROM ed GROUP BY ALL",
    "e05_chain_vectors": with_("s", "t", "m", _COOC, _COS) + "SELECT doc_id, chain_id, col_tok, v::DOUBLE AS v FROM v",
    "e06_chain_cosine": with_("s", "t", "m", _COOC, _COS) + "SELECT doc_id, chain_id, score FROM cs",
    "f05_fusion": with_(*_G, _LIDF, "ld AS (SELECT DISTINCT doc_id, 1 AS chain_id FROM ch)", _LSC, _COOC, _COS)
    + """, fu AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.chain_id, b.chain_id) AS chain_id, round(0.6 * coalesce(a.score, 0.0) + 0.4 * coalesce(b.score, 0.0), 6) AS score,
    CASE WHEN coalesce(a.score, 0) > 0 AND coalesce(b.score, 0) > 0 THEN 'both' WHEN coalesce(a.score, 0) > 0 THEN 'trie' ELSE 'cooc' END AS why FROM (SELECT * FROM ls WHERE chain_id > 1) a FULL JOIN cs b ON a.doc_id = b.doc_id AND a.chain_id = b.chain_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chain_id) AS rank FROM fu) WHERE rank <= 5""",
    "e17_hits_by_document": with_(*_G, _IDF, _probe(1)) + "SELECT doc_id, count(*) AS n, max(score) AS best FROM sc GROUP BY doc_id",
    "d05_stab": with_("s", _GRID.format(50)) + "SELECT p.doc_id, p.begin AS point, sentence_id FROM gr50 p JOIN s ON p.doc_id = s.doc_id AND p.begin >= s.start AND p.begin < s.stop",
    "d06_overlap": with_("s", _GRID.format(100)) + "SELECT p.doc_id, p.begin, sentence_id FROM gr100 p JOIN s ON p.doc_id = s.doc_id AND s.start < p.begin + 60 AND s.stop > p.begin",
    "d07_containment": with_("s", _GRID.format(40)) + "SELECT p.doc_id, p.begin, min(sentence_id) AS sentence_id FROM gr40 p JOIN s ON p.doc_id = s.doc_id AND s.start <= p.begin AND p.begin + 10 <= s.stop GROUP BY ALL",
    "d08_span_to_chain": with_("s", _W, _WM, _GRID.format(100), _S2C) + "SELECT doc_id, span_id, chain_id FROM sc2",
    "d08_related": with_("s", _W, _WM, _GRID.format(100), _S2C) + "SELECT * FROM (SELECT sc2.doc_id, span_id, start, row_number() OVER (PARTITION BY sc2.doc_id, span_id ORDER BY start, stop) AS k FROM sc2 JOIN wm ON wm.doc_id = sc2.doc_id AND wm.chain_id = sc2.chain_id WHERE NOT (start = begin AND stop = begin + 30)) WHERE k <= 5",
    "d09_mention_sentences": with_("s", _W, _WM) + "SELECT wm.doc_id, chain_id, sentence_id, count(*) AS n, min(wm.start - s.start) AS first FROM wm JOIN s ON wm.doc_id = s.doc_id AND s.start <= wm.start AND wm.stop <= s.stop GROUP BY ALL",
    "d12_best_overlap": with_("s", _GRID.format(90), "ov AS (SELECT p.doc_id, sentence_id, stop - start AS len, (begin // 90) * 7 % 11 / 10.0::DOUBLE AS score, least(stop, begin + 70) - greatest(start, begin) AS overlap FROM gr90 p JOIN s ON p.doc_id = s.doc_id AND start < begin + 70 AND stop > begin)", "bo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY score DESC, overlap DESC) AS k FROM ov)") + "SELECT doc_id, sentence_id, score, overlap FROM bo WHERE k = 1 ORDER BY score DESC, overlap DESC, len, doc_id, sentence_id LIMIT 200",
    "d16_mention_buckets": with_("s", _W, _WM) + "SELECT wm.doc_id, chain_id, CASE WHEN wm.start % 7 = 0 THEN -1 ELSE sentence_id END AS sentence_id, count(*) AS n FROM wm LEFT JOIN s ON wm.doc_id = s.doc_id AND s.start <= wm.start AND wm.stop <= s.stop GROUP BY ALL",
    "h04_chains": with_("s", "t", "m") + "SELECT doc_id, chain_id, head, count(*) AS n_mentions, (array_agg(text ORDER BY length(text) DESC, text))[1] AS representative FROM m GROUP BY ALL",
    "b16_representative": with_("s", "t", "m") + "SELECT doc_id, chain_id, (array_agg(text ORDER BY length(text) DESC, sentence_id, pos))[1] AS representative FROM m GROUP BY ALL",
    "f13_antecedents": with_("s", _ANTE) + "SELECT * FROM an",
    "e09_tag_histogram": with_("s", _ANTE) + "SELECT doc_id, replace(tag, '-', '_') AS tag, count(*) AS n FROM an GROUP BY ALL",
    "e08_chain_statistics": with_("s", _ANTE) + "SELECT fw.doc_id, count(*) AS mentions, count(DISTINCT sentence_id) AS sentences, (array_agg(text ORDER BY length(text) DESC, text))[1][1:40] AS name, coalesce(any_value(o.n), 0) AS other FROM fw LEFT JOIN (SELECT doc_id, count(*) AS n FROM an WHERE tag = 'OTHER' GROUP BY doc_id) o USING (doc_id) GROUP BY fw.doc_id",
    "e10_keyphrase_clusters": with_("s", "t", "m") + r"SELECT doc_id, chain_id, count(DISTINCT text) AS n, count(DISTINCT sentence_id) AS sents, min(text) AS first FROM m WHERE regexp_matches(text, '\p{L}') GROUP BY doc_id, chain_id HAVING count(DISTINCT sentence_id) >= 2",
    "g09_clusters_by_mention": with_("s", "t", "m") + "SELECT doc_id, chain_id, string_agg(DISTINCT sentence_id::VARCHAR, ',' ORDER BY sentence_id) AS members FROM (SELECT DISTINCT doc_id, chain_id, sentence_id FROM m) GROUP BY doc_id, chain_id".replace("string_agg(DISTINCT sentence_id::VARCHAR", "string_agg(sentence_id::VARCHAR"),
    "g10_clusters_by_seed": with_("s", "t", "m").replace("WITH ", "WITH RECURSIVE ", 1) + """, sc AS (SELECT s.doc_id, s.sentence_id, coalesce(list(DISTINCT chain_id) FILTER (WHERE chain_id IS NOT NULL), []) AS c FROM s LEFT JOIN m ON m.doc_id = s.doc_id AND m.sentence_id = s.sentence_id GROUP BY ALL),
  dm AS (SELECT doc_id, list(sentence_id ORDER BY sentence_id) AS ids, map_from_entries(list((sentence_id, c))) AS held FROM sc GROUP BY doc_id),
  st(doc_id, held, rest, k, members) AS (SELECT doc_id, held, ids, -1, [-1::BIGINT] FROM dm UNION ALL SELECT doc_id, held, list_filter(rest, lambda x: NOT list_contains(g, x)), k + 1, g FROM (SELECT *, list_filter(rest, lambda x: x = rest[1] OR list_has_any(held[x], held[rest[1]])) AS g FROM st WHERE len(rest) > 0))
SELECT doc_id, k::BIGINT AS cluster_id, array_to_string(members, ',') AS members FROM st WHERE k >= 0""",
    "d10_touching": with_("s", "t", "m") + "SELECT doc_id, chain_id, sentence_id, count(*) AS n FROM m WHERE doc_id = 499 AND chain_id IN (SELECT chain_id FROM m WHERE doc_id = 499 AND sentence_id = 0) GROUP BY ALL",
    "b17_pronouns_resolved": with_("s", _W, f"lw AS (SELECT doc_id, max(length(word)) AS n FROM w GROUP BY doc_id), pw AS (SELECT w.doc_id, sentence_id, sum(n - length(word)) AS more FROM w JOIN lw USING (doc_id) WHERE {_PK.format('word')} IN ({_PRON}) GROUP BY ALL)") + "SELECT doc_id, sentence_id, (length(text) + coalesce(more, 0))::BIGINT AS n FROM s LEFT JOIN pw USING (doc_id, sentence_id)",
    "a21_index_sizes": with_(*_G) + "SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id ORDER BY size DESC, doc_id LIMIT 20",
}
ORACLE["d05_stab_bucketed"] = ORACLE["d05_stab"]
