"""Queries over text expressions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import predicates as P
from lexloom.functions import scores as S
from lexloom.functions import text as T
from lexloom.operators import concordance, corpus, spans
from lexloom.plans.views import documents, mentions, sentences, table, wide, with_

C = F.col
TERMS = ["estion", "the", "and"]


def _docs(expr):
    return lambda spark, sf: wide(table(spark, sf, "documents").select("doc_id", *expr()))


def _sents(expr):
    return lambda spark, sf: wide(sentences(spark, sf).select("doc_id", "sentence_id", *expr()))


def _hash(c):
    return F.md5(F.coalesce(c, F.lit("")))


def _pairs(spark, sf):
    """Each sentence with the next one of its document."""
    s = sentences(spark, sf).select("doc_id", "sentence_id", "text")
    after = s.select("doc_id", (C("sentence_id") - 1).alias("sentence_id"), C("text").alias("next"))
    return s.join(after, ["doc_id", "sentence_id"])


_NEXT = with_("s", "n AS (SELECT a.doc_id, a.sentence_id, a.text, b.text AS next FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id - 1)")
_STRIP = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


def _colour(expr):
    """Colours and scores made of document ids."""
    rgb = lambda: F.lpad(F.hex((C("doc_id") * 7919) % 16777216), 6, "0")
    return lambda spark, sf: wide(table(spark, sf, "documents").select("doc_id", rgb().alias("rgb")).select("doc_id", *expr()))


_RGB = "c AS (SELECT doc_id, lpad(printf('%X', (doc_id * 7919) % 16777216), 6, '0') AS rgb FROM documents)"
_HSV = """h0 AS (SELECT doc_id, ('0x' || substr(rgb, 1, 2))::INT / 255.0::DOUBLE AS r, ('0x' || substr(rgb, 3, 2))::INT / 255.0::DOUBLE AS g, ('0x' || substr(rgb, 5, 2))::INT / 255.0::DOUBLE AS b FROM c),
  h1 AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM h0),
  h2 AS (SELECT *, CASE WHEN mx = mn THEN 0 ELSE (CASE WHEN r = mx THEN (mx - b) / (mx - mn) - (mx - g) / (mx - mn) WHEN g = mx THEN 2.0 + (mx - r) / (mx - mn) - (mx - b) / (mx - mn)
     ELSE 4.0 + (mx - g) / (mx - mn) - (mx - r) / (mx - mn) END) / 6.0 END AS turn FROM h1),
  h AS (SELECT doc_id, round((turn - floor(turn)) * 360, 1) AS hue, round(CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx END, 3) AS sat, round(mx, 3) AS val FROM h2),
  sc AS (SELECT *, CASE WHEN hue BETWEEN 90 AND 150 THEN sat * val WHEN hue <= 15 OR hue >= 345 THEN -(sat * val) ELSE 0.0 END AS score FROM h)"""


def _consensus(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    conf, other = (C("n_chars") % 100) / 100.0, (C("n_chars") % 37) / 37.0
    return wide(d.select("doc_id", S.consensus(C("quality"), conf, F.when(C("doc_id") % 5 > 0, C("toxic")), other).alias("consensus")))


def _iou(spark, sf):
    box = lambda k: F.struct((C("doc_id") % k).cast("double").alias("l"), (C("doc_id") % (k + 2)).cast("double").alias("t"), (C("doc_id") % k + 5).cast("double").alias("r"), (C("doc_id") % (k + 2) + 4).cast("double").alias("b"))
    return table(spark, sf, "documents").select("doc_id", F.round(S.iou(box(7), box(5)), 6).alias("iou"))


def _resolution(spark, sf):
    s = sentences(spark, sf).withColumn("at", F.instr("text", " it ")).where("at > 0")
    return s.withColumn("r", F.array(F.struct(C("at").alias("start"), (C("at") + 2).alias("end"), F.lit("the thing").alias("by"))))


def _mention_pairs(spark, sf):
    m = mentions(spark, sf)
    return m.select("doc_id", "chain_id", "sentence_id", "pos", "text", "prev", "head")


CITE = r"(?i)" + "|".join(f"(?:{p})" for p in P.CITATION_PATTERNS)
VERB = "|".join(P.VERBS)
_BARE = strip(r"regexp_replace(regexp_replace({0}, '\([^)]*\d{{4}}[^)]*\)', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')")


def _meaningful(x: str) -> str:
    bare = _BARE.format(x)
    return f"(len(list_filter(string_split({bare}, ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$'))) >= 5 AND regexp_matches(lower({bare}), '{VERB}') AND regexp_matches({strip(x)}, '[.!?;]$'))"


_ONE = strip(r"regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')")
_PRON = ", ".join(f"'{p}'" for p in T.PRONOUNS)
_WORDS = r"list_filter(string_split_regex(lower({0}), '[ \t\n\r\f]+'), lambda w: w <> '')"


def _jac(a: str, b: str) -> str:
    x, y = f"list_distinct({_WORDS.format(a)})", f"list_distinct({_WORDS.format(b)})"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


def _ratio(a: str, b: str) -> str:
    return f"least(greatest(length({a}), 1), greatest(length({b}), 1))::DOUBLE / greatest(length({a}), length({b}), 1)"


def _lexical(mode):
    return lambda spark, sf: wide(concordance.lexical(sentences(spark, sf), documents(spark, sf), ["thing", "and"], mode, 500).select("doc_id", "sentence_id", _hash(C("text")).alias("h"), "start", C("end").alias("stop"), "path", "score"))


def _lexical_sql(op: str) -> str:
    return with_("s") + f"""SELECT s.doc_id, sentence_id, md5(s.text) AS h, start, stop, 'corpus://' || source || '/' || s.doc_id AS path,
  ((length(lower(s.text)) - length(replace(lower(s.text), 'thing', ''))) // 5 + (length(lower(s.text)) - length(replace(lower(s.text), 'and', ''))) // 3)::DOUBLE AS score
FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE contains(lower(s.text), 'thing') {op} contains(lower(s.text), 'and') ORDER BY s.doc_id, sentence_id LIMIT 500"""


QUERIES = {
    "b01_normalised": _docs(lambda: [_hash(T.normalised(C("text"))).alias("h"), F.length(T.normalised(C("text"), 400)).alias("cut")]),
    "b02_without_citations": _docs(lambda: [_hash(T.without_citations(F.concat(C("text"), F.lit(" as shown [1, 2-5] [Smith et al., 2020] [Doe, 1999] (3) (2024) ²³ .")))).alias("h")]),
    "b03_without_artifacts": _docs(lambda: [_hash(T.without_artifacts(F.concat(F.lit("Vol.(12) x\nResearch\n© 2020 y\n\n\n\nsee https://doi.org/10.1/x now\n"), C("text")))).alias("h")]),
    "b04_prepared": _docs(lambda: [_hash(T.prepared(C("text"))).alias("h")]),
    "b05_sentences": _sents(lambda: ["start", C("end").alias("stop"), _hash(C("text")).alias("h")]),
    "b06_claims": _docs(lambda: [F.size(T.claims(C("text"))).alias("n"), _hash(F.array_join(T.claims(C("text")), "|")).alias("h")]),
    "b07_content_sentences": lambda spark, sf: wide(corpus.filtered_sentences(sentences(spark, sf), P.is_content).select("doc_id", "sentence_id")),
    "b08_content_tokens": _sents(lambda: [F.size(T.content_tokens(C("text"), ("the", "and", "of"))).alias("n"), _hash(F.array_join(T.content_tokens(C("text"), ("the", "and", "of")), " ")).alias("h")]),
    "b09_heads": _sents(lambda: [F.array_join(T.heads(C("text")), "|").alias("head")]),
    "b10_char_grams": _docs(lambda: [F.size(T.char_grams(C("text"))).alias("n"), _hash(F.array_join(T.char_grams(C("text")), "|")).alias("h"), F.size(T.plain_char_grams(C("text"))).alias("plain")]),
    "b11_token_grams": _sents(lambda: [_hash(F.array_join(T.let(T.tokens(C("text")), lambda w: F.concat(T.token_grams(w, 2), T.token_grams(w, 3))), "|")).alias("h")]),
    "b12_gram_bag": lambda spark, sf: wide(table(spark, sf, "benchmark").select("item_id", F.explode(T.grams(C("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))),
    "b13_mention_keys": _sents(lambda: [_hash(T.mention_key(C("text"))).alias("h"), _hash(T.trimmed_mention(C("text"))).alias("t")]),
    "b14_pronouns": lambda spark, sf: wide(corpus.sentence_tokens(sentences(spark, sf)).select("token", T.is_pronoun(C("token")).alias("p"), T.is_short_pronoun(C("token")).alias("q")).where("p or q").groupBy("token", "p", "q").agg(F.count(F.lit(1)).alias("n"))),
    "b15_edge_tags": lambda spark, sf: wide(_pairs(spark, sf).select(T.edge_tag(F.split("text", " ")[0], F.split("next", " ")[0]).alias("tag"), T.relation(F.split("text", " ")[0], F.split("next", " ")[0]).alias("relation")).groupBy("tag", "relation").agg(F.count(F.lit(1)).alias("n"))),
    "b17_resolved": lambda spark, sf: wide(_resolution(spark, sf).select("doc_id", "sentence_id", _hash(T.resolved(C("text"), C("r"))).alias("h"))),
    "b18_alignment": lambda spark, sf: wide(_resolution(spark, sf).select("doc_id", "sentence_id", F.explode(T.alignment(C("text"), C("r"))).alias("x")).select("doc_id", "sentence_id", "x.*")),
    "b19_query_text": _sents(lambda: [T.preview(C("text"), 40).alias("preview"), _hash(T.spaced(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[.,;:!?]"), F.lit(0)))).alias("h"), _hash(T.phrase_query(F.slice(T.tokens(C("text")), 1, 5))).alias("q")]),
    "b20_bold": lambda spark, sf: wide(sentences(spark, sf).select("doc_id", "sentence_id", T.bold(C("text"), TERMS).alias("b"), "text").where("b <> text").select("doc_id", "sentence_id", _hash(C("b")).alias("h"))),
    "b20_highlighted": lambda spark, sf: wide(_resolution(spark, sf).select("doc_id", "sentence_id", _hash(T.highlighted(C("text"), F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))).alias("h"))),
    "b21_urls": lambda spark, sf: wide(table(spark, sf, "pages").select("page_id", F.size(T.urls(F.concat("html", F.lit(" https://doi.org/https://doi.org/10.1016/j.x.2020.01. "), "url"))).alias("n"), F.array_join(T.urls(F.concat("html", F.lit(" https://doi.org/https://doi.org/10.1016/j.x.2020.01. "), "url")), " ").alias("urls"), T.doi(F.concat(F.lit("see 10.1016/j.x."), C("page_id").cast("string"), F.lit(". and"))).alias("doi"))),
    "b22_doi_list": _docs(lambda: [F.array_join(T.doi_list(F.when(C("doc_id") % 3 == 0, F.concat(F.lit('["10.1/a'), C("doc_id").cast("string"), F.lit('", "10.2/b"]'))).when(C("doc_id") % 3 == 1, F.concat(F.lit("10.1/a, ,10.3/"), C("source")))), "|").alias("dois")]),
    "b23_hsv": _colour(lambda: [S.hsv(C("rgb"))["h"].alias("hue"), S.hsv(C("rgb"))["s"].alias("sat"), S.hsv(C("rgb"))["v"].alias("val")]),
    "b24_signed_score": _colour(lambda: [F.round(S.signed_score(C("rgb")), 6).alias("score")]),
    "b25_likert": _colour(lambda: [S.likert(S.signed_score(C("rgb"))).alias("likert")]),
    "b26_theme": _docs(lambda: [S.theme_colour(C("doc_id") % 12).alias("colour")]),
    "b27_value_likert": _docs(lambda: [S.value_and_likert(F.concat("source", F.when(C("doc_id") % 2 == 0, F.concat(F.lit("|"), (C("doc_id") % 11 - 5).cast("string"))).otherwise("")))["value"].alias("value"), S.value_and_likert(F.concat("source", F.when(C("doc_id") % 2 == 0, F.concat(F.lit("|"), (C("doc_id") % 11 - 5).cast("string"))).otherwise("")))["likert"].alias("likert")]),
    "b28_scaling": _docs(lambda: [F.array_join(F.transform(S.scaled(F.array((C("doc_id") % 7).cast("double"), (C("doc_id") % 5).cast("double"), (C("doc_id") % 3).cast("double"))), lambda x: F.format_number(x, 4)), "|").alias("scaled"), S.chain_hue(C("doc_id")).alias("hue")]),
    "b29_names": _docs(lambda: [S.encoder_name(F.when(C("doc_id") % 2 == 0, F.lit(" MiniLM")).otherwise(F.lit("mpnet"))).alias("name"), S.cells(C("n_chars")).alias("cells")]),
    "b33_pair_measures": lambda spark, sf: wide(_pairs(spark, sf).select("doc_id", "sentence_id", F.round(T.length_ratio(C("text"), C("next")), 6).alias("ratio"), F.round(T.word_jaccard(C("text"), C("next")), 6).alias("jaccard"))),
    "b34_iou": _iou,
    "b35_strength": _docs(lambda: [T.strength((C("n_chars") % 101) / 100.0).alias("strength")]),
    "b36_consensus": _consensus,
    "b37_fingerprint": _docs(lambda: [_hash(T.rtrimmed(F.concat("text", F.lit(" \n")))).alias("h"), T.fingerprint("lang", "source").alias("f")]),
    "c01_lexical_and": _lexical("AND"),
    "c01_lexical_or": _lexical("OR"),
    "c02_contains_any": lambda spark, sf: wide(sentences(spark, sf).where(P.contains_any(C("text"), ["thing%", "EST"])).select("doc_id", "sentence_id")),
    "c03_citations": _sents(lambda: [P.is_citation(C("text")).alias("hit")]),
    "c04_meaningful": _sents(lambda: [P.is_meaningful(C("text")).alias("hit")]),
    "c05_lookup_and": lambda spark, sf: wide(concordance.lookup(concordance.inverted(sentences(spark, sf)), ["the", "and"], True)),
    "c05_lookup_or": lambda spark, sf: wide(concordance.lookup(concordance.inverted(sentences(spark, sf)), ["edst", "onre"], False)),
    "c06_word_positions": lambda spark, sf: wide(concordance.word_positions(sentences(spark, sf), F.array(F.struct(F.lit(3).alias("a"), F.lit(12).alias("b")), F.struct(F.lit(30).alias("a"), F.lit(31).alias("b"))))),
    "c08_cheap_pairs": lambda spark, sf: wide(_pairs(spark, sf).where(P.cheaply_alike(C("text"), C("next"))).select("doc_id", "sentence_id")),
    "a05_inverted_index": lambda spark, sf: wide(concordance.inverted(sentences(spark, sf)).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))),
    "f17_kwic": lambda spark, sf: wide(concordance.kwic(sentences(spark, sf), "thing", 20)),
    "h09_token_importance": lambda spark, sf: wide(spans.token_importance(sentences(spark, sf)).groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("total"), F.max("end").alias("last"), F.sum("start").alias("starts"))),
    "f19_span_enumeration": lambda spark, sf: wide(spans.enumerated(sentences(spark, sf)).select("doc_id", "sentence_id", "start", C("end").alias("stop"), "span", "importance")),
    "f03_ranked_spans": lambda spark, sf: wide(spans.ranked_runs(sentences(spark, sf)).select("doc_id", "sentence_id", "start", C("end").alias("stop"), "importance", "rank")),
}

_W = r"""w0 AS (SELECT doc_id, sentence_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws, string_split_regex(text, '[^ \t\n\x0B\f\r]+') AS gs FROM s),
  w1 AS (SELECT doc_id, sentence_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM w0),
  w2 AS (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos))::BIGINT AS stop FROM w1),
  w AS (SELECT *, stop - length(word) AS start FROM w2)"""
_ENUM = "e AS (SELECT a.doc_id, a.sentence_id, a.start, b.stop, substr(s.text, a.start + 1, b.stop - a.start) AS span, (b.stop - a.start)::DOUBLE AS importance FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND b.pos BETWEEN a.pos AND a.pos + 3 JOIN s ON s.doc_id = a.doc_id AND s.sentence_id = a.sentence_id)"
_GRAMS = "CASE WHEN length({0}) >= 4 THEN list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)) ELSE [] END"
_FLAT = r"trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'))"
_CLEAN = rf"regexp_replace({_FLAT}, '[^\p{{L}}\p{{N}}_ ]+', '', 'g')"
_TAIL = r"' as shown [1, 2-5] [Smith et al., 2020] [Doe, 1999] (3) (2024) ²³ .'"


def _tg(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i+{n - 1}], '§')) ELSE [] END"


_FIRST = "split_part({0}, ' ', 1)"
_PK = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_SHORT = ", ".join(f"'{p}'" for p in T.SHORT_PRONOUNS)


def _replace_all(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_PARAS = f"list_filter(list_transform(string_split({strip(chr(123) + '0' + chr(125))}, chr(1)), lambda p: {strip('p')}), lambda p: length(p) >= 20 AND NOT regexp_matches(p, '^[0-9]+$'))"
_JOINED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*', '', 'g'), '\n[ \t\n\x0B\f\r]*\n+', chr(1), 'g'), '\n+', ' ', 'g'), '[ \t]+', ' ', 'g')"
_NORM = "array_to_string(" + _PARAS.replace("{0}", _JOINED) + ", chr(10) || chr(10))"

ORACLE = {
    "b01_normalised": f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents), c AS (SELECT *, substr(t, 1, 400) AS head FROM n),
  k AS (SELECT *, CASE WHEN contains(head, '.') THEN length(head) - strpos(reverse(head), '.') + 1 ELSE 0 END AS stop FROM c)
SELECT doc_id, md5(t) AS h, length(CASE WHEN length(t) <= 400 THEN t ELSE {strip("CASE WHEN stop - 1 > 320 THEN substr(head, 1, stop) ELSE head END")} END) AS cut FROM k""",
    "b02_without_citations": "WITH a AS (SELECT doc_id, "
    + _replace_all(f"text || {_TAIL}", (r"\[\d+(?:[,\-]\s*\d+)*\]", ""), (r"\[[\w\s]+et al\.,?\s*\d{4}\]", ""), (r"\[[\w\s]+,?\s*\d{4}\]", ""), ("[¹²³⁴⁵⁶⁷⁸⁹⁰]+", ""))
    + r""" AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '\((\d+(?:,\s*\d+)*)\)(\s*\d{3})', chr(2) || '\1' || chr(3) || '\2', 'g') AS t FROM a),
  c AS (SELECT doc_id, replace(replace(regexp_replace(t, '\((\d+(?:,\s*\d+)*)\)', '', 'g'), chr(2), '('), chr(3), ')') AS t FROM b)
SELECT doc_id, md5("""
    + strip(_replace_all("t", (r"\s+", " "), (r"\s+([.,;:!?])", r"\1")))
    + ") AS h FROM c",
    "b03_without_artifacts": r"""WITH a AS (SELECT doc_id, string_split('Vol.(12) x' || chr(10) || 'Research' || chr(10) || '© 2020 y' || chr(10) || chr(10) || chr(10) || chr(10) || 'see https://doi.org/10.1/x now' || chr(10) || text, chr(10)) AS ls FROM documents),
  b AS (SELECT doc_id, list_filter(ls, lambda x: NOT (length(trim(x)) > 0 AND length(trim(x)) < 80 AND (regexp_matches(trim(x), '^Vol\.:?\(?\d+\)') OR regexp_matches(trim(x), '^https?://doi\.org/') OR regexp_matches(trim(x), '^©\s*\d{4}') OR trim(x) IN ('Discover Sustainability', 'Research')))) AS ls FROM a)
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(ls, lambda x: regexp_replace(regexp_replace(x, 'https?://doi\.org/[\S]+', '', 'g'), 'Vol\.:?\(?\d+\)', '', 'g')), chr(10)), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) AS h FROM b""",
    "b04_prepared": r"""SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: lower(w)), ' '), '[`"]', '', 'g'))) AS h FROM documents""",
    "b05_sentences": with_("s") + "SELECT doc_id, sentence_id, start, stop, md5(text) AS h FROM s",
    "b06_claims": f"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {strip("x")}), lambda x: length(x) > 10) AS c FROM documents)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS h FROM c""",
    "b07_content_sentences": with_("s", f"o AS (SELECT doc_id, sentence_id, {_ONE} AS text FROM s)") + f"SELECT doc_id, sentence_id FROM o WHERE length(text) >= 20 AND NOT regexp_matches(text, '{CITE}') AND {_meaningful('text')} AND len(string_split(text, ' ')) >= 6",
    "b08_content_tokens": with_("s", "t") + "SELECT doc_id, sentence_id, len(list_filter(ts, lambda x: x NOT IN ('the', 'and', 'of'))) AS n, md5(array_to_string(list_filter(ts, lambda x: x NOT IN ('the', 'and', 'of')), ' ')) AS h FROM tl",
    "b09_heads": with_("s", "t") + "SELECT doc_id, sentence_id, coalesce(ts[len(ts)], '') AS head FROM tl",
    "b10_char_grams": f"WITH c AS (SELECT doc_id, {_FLAT} AS p, {_CLEAN} AS c FROM documents) SELECT doc_id, len({_GRAMS.format('c')}) AS n, md5(array_to_string({_GRAMS.format('c')}, '|')) AS h, len({_GRAMS.format('p')}) AS plain FROM c",
    "b11_token_grams": with_("s", "t") + f"SELECT doc_id, sentence_id, md5(array_to_string(list_concat({_tg('ts', 2)}, {_tg('ts', 3)}), '|')) AS h FROM tl",
    "b12_gram_bag": rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ts, {_CLEAN} AS c FROM benchmark),
  g AS (SELECT item_id, unnest(list_concat({_tg("ts", 2)}, {_tg("ts", 3)}, {_GRAMS.format("c")}, CASE WHEN len(ts) > 0 THEN [ts[len(ts)]] ELSE [] END)) AS gram FROM b)
SELECT item_id, gram, count(*) AS cnt FROM g GROUP BY ALL""",
    "b13_mention_keys": with_("s") + rf"""SELECT doc_id, sentence_id, md5({_FLAT}) AS h, md5(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), '^[.,;:!?"''()\[\]{{}} ]+|[.,;:!?"''()\[\]{{}} ]+$', '', 'g')) AS t FROM s""",
    "b14_pronouns": with_("s", "t", f"q AS (SELECT token, {_PK.format('token')} IN ({_PRON}) AS p, token IN ({_SHORT}) AS q FROM t)") + "SELECT token, p, q, count(*) AS n FROM q WHERE p OR q GROUP BY ALL",
    "b15_edge_tags": _NEXT + f""", f AS (SELECT {strip(_FIRST.format('text'))} AS a, {strip(_FIRST.format('next'))} AS b, lower({_FIRST.format('text')}) AS la, lower({_FIRST.format('next')}) AS lb FROM n),
  k AS (SELECT *, {_PK.format('a')} AS ka, {_PK.format('b')} AS kb FROM f), z AS (SELECT *, ka IN ({_PRON}) AS pa, kb IN ({_PRON}) AS pb FROM k)
SELECT CASE WHEN pa AND pb AND ka = kb THEN 'PRON-PRON-C' WHEN pa AND pb THEN 'PRON-PRON-NC' WHEN a <> '' AND a = b THEN 'MATCH' WHEN a <> '' AND b <> '' AND (contains(b, a) OR contains(a, b)) THEN 'CONTAINS'
    WHEN NOT pa AND pb THEN 'ENT-PRON' ELSE 'OTHER' END AS tag,
  CASE WHEN la = lb THEN 'MATCH' WHEN contains(lb, la) OR contains(la, lb) THEN 'CONTAINS' WHEN trim(la) IN ({_SHORT}) OR trim(lb) IN ({_SHORT}) THEN 'ENT_PRON' ELSE 'OTHER' END AS relation, count(*) AS n FROM z GROUP BY ALL""",
    "b17_resolved": with_("s") + "SELECT doc_id, sentence_id, md5(substr(text, 1, strpos(text, ' it ')) || 'the thing' || substr(text, strpos(text, ' it ') + 3)) AS h FROM s WHERE contains(text, ' it ')",
    "b18_alignment": with_("s", "a AS (SELECT *, strpos(text, ' it ') AS p0, length(text) AS n FROM s WHERE contains(text, ' it '))")
    + """SELECT doc_id, sentence_id, 0::BIGINT AS orig_start, p0 AS orig_end, 0::BIGINT AS res_start, p0 AS res_end FROM a
UNION ALL SELECT doc_id, sentence_id, p0, p0 + 2, p0, p0 + 9 FROM a UNION ALL SELECT doc_id, sentence_id, p0 + 2, n, p0 + 9, n + 7 FROM a WHERE p0 + 2 < n""",
    "b19_query_text": with_("s", "t", "k AS (SELECT s.*, ts FROM s JOIN tl USING (doc_id, sentence_id))")
    + r"""SELECT doc_id, sentence_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS preview,
  md5(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[.,;:!?]'), ' '), ' +([.,;:!?)\]}])', '\1', 'g'), '([(\[{]) +', '\1', 'g')) AS h,
  md5(array_to_string(list_transform(list_filter(ts[1:5], lambda x, i: list_position(ts[1:5], x) = i), lambda x: '"' || x || '"'), ' ')) AS q FROM k""",
    "b20_bold": with_("s", r"b AS (SELECT *, regexp_replace(text, '(?i)\b(estion|and|the)\b', '<b>\1</b>', 'g') AS b FROM s)") + "SELECT doc_id, sentence_id, md5(b) AS h FROM b WHERE b <> text",
    "b20_highlighted": with_("s") + "SELECT doc_id, sentence_id, md5(substr(text, 1, strpos(text, ' it ')) || '<mark>it</mark>' || substr(text, strpos(text, ' it ') + 3)) AS h FROM s WHERE contains(text, ' it ')",
    "b21_urls": r"""WITH u AS (SELECT page_id, list_transform(regexp_extract_all(html || ' https://doi.org/https://doi.org/10.1016/j.x.2020.01. ' || url, 'https?://[^\s\])>"''<]+'), lambda u: regexp_replace(regexp_replace(u, '[.,;:]+$', ''), '^(https?://doi\.org/)(?:https?://doi\.org/)+', '\1')) AS us FROM pages)
SELECT page_id, len(us) AS n, array_to_string(us, ' ') AS urls, '10.1016/j.x.' || page_id AS doi FROM u""",
    "b22_doi_list": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '10.1/a' || doc_id || '|10.2/b' WHEN 1 THEN '10.1/a|10.3/' || source ELSE '' END AS dois FROM documents",
    "b23_hsv": f"WITH {_RGB}, {_HSV} SELECT doc_id, hue, sat, val FROM h",
    "b24_signed_score": f"WITH {_RGB}, {_HSV} SELECT doc_id, round(score, 6) + 0.0 AS score FROM sc",
    "b25_likert": f"WITH {_RGB}, {_HSV} SELECT doc_id, (CASE WHEN score = 0 THEN 0 ELSE sign(score) * greatest(1, round_even(least(abs(score), 1.0) * 5, 0)) END)::BIGINT AS likert FROM sc",
    "b26_theme": "SELECT doc_id, CASE doc_id % 12 WHEN 9 THEN 'FF00FF00' WHEN 10 THEN 'FFFF0000' END AS colour FROM documents",
    "b27_value_likert": "SELECT doc_id, source AS value, CASE WHEN doc_id % 2 = 0 THEN doc_id % 11 - 5 END AS likert FROM documents",
    "b28_scaling": """WITH v AS (SELECT doc_id, [(doc_id % 7)::DOUBLE, (doc_id % 5)::DOUBLE, (doc_id % 3)::DOUBLE] AS v FROM documents), r AS (SELECT *, list_min(v) AS lo, list_max(v) - list_min(v) AS span FROM v)
SELECT doc_id, array_to_string(list_transform(v, lambda x: printf('%.4f', round((x - lo) / CASE WHEN span = 0 THEN 1.0 ELSE span END, 6))), '|') AS scaled, round((doc_id * 0.618033988749895::DOUBLE) % 1.0::DOUBLE * 360, 3) AS hue FROM r""",
    "b29_names": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bge-base-en-v1.5' ELSE 'all-mpnet-base-v2' END AS name, least(4096, greatest(1, round_even(sqrt(n_chars), 0)))::BIGINT AS cells FROM documents",
    "b33_pair_measures": _NEXT + f"SELECT doc_id, sentence_id, round({_ratio('text', 'next')}, 6) AS ratio, round({_jac('text', 'next')}, 6) AS jaccard FROM n",
    "b34_iou": """WITH b AS (SELECT doc_id, (doc_id % 7)::DOUBLE AS l, (doc_id % 9)::DOUBLE AS t, (doc_id % 5)::DOUBLE AS l2, (doc_id % 7)::DOUBLE AS t2 FROM documents),
  i AS (SELECT *, least(l, l2) + 5 - greatest(l, l2) AS w, least(t, t2) + 4 - greatest(t, t2) AS h FROM b)
SELECT doc_id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0.0 ELSE w * h / (40 - w * h) END, 6) AS iou FROM i""",
    "b35_strength": "WITH s AS (SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS x FROM documents) SELECT doc_id, CASE WHEN x >= 0.8 THEN 'Very Strong' WHEN x >= 0.6 THEN 'Strong' WHEN x >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength FROM s",
    "b36_consensus": """WITH d AS (SELECT doc_id, quality AS a, CASE WHEN doc_id % 5 > 0 THEN toxic END AS b, (n_chars % 100) / 100.0::DOUBLE AS p, (n_chars % 37) / 37.0::DOUBLE AS q FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN b IS NULL AND p >= 0.5 THEN 'bert_only' WHEN b IS NULL THEN 'mistrust' WHEN p < 0.5 AND q < 0.5 THEN 'mistrust' WHEN a = b AND p >= 0.5 AND q >= 0.5 THEN 'agreement'
  WHEN abs(p - q) >= 0.2 AND p > q THEN 'bert_only' WHEN abs(p - q) >= 0.2 THEN 'similarity_only' WHEN a <> b AND abs(p - q) >= 0.1 THEN 'disagreement' WHEN p >= 0.5 THEN 'bert_only' WHEN q >= 0.5 THEN 'similarity_only' ELSE 'disagreement' END AS consensus FROM d""",
    "b37_fingerprint": rf"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]+$', '')) AS h, sha1(lang || '|' || source) AS f FROM documents",
    "c01_lexical_and": _lexical_sql("AND"),
    "c01_lexical_or": _lexical_sql("OR"),
    "c02_contains_any": with_("s") + "SELECT doc_id, sentence_id FROM s WHERE contains(lower(text), 'thing%') OR contains(lower(text), 'est')",
    "c03_citations": with_("s") + f"SELECT doc_id, sentence_id, regexp_matches(text, '{CITE}') AS hit FROM s",
    "c04_meaningful": with_("s") + f"SELECT doc_id, sentence_id, {_meaningful('text')} AS hit FROM s",
    "c05_lookup_and": with_("s", r"i AS (SELECT doc_id, sentence_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_-]*') AS ws FROM s)") + "SELECT doc_id, sentence_id FROM i WHERE list_contains(ws, 'the') AND list_contains(ws, 'and')",
    "c05_lookup_or": with_("s", r"i AS (SELECT doc_id, sentence_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_-]*') AS ws FROM s)") + "SELECT doc_id, sentence_id FROM i WHERE list_contains(ws, 'edst') OR list_contains(ws, 'onre')",
    "c06_word_positions": with_("s", _W) + "SELECT doc_id, sentence_id, pos, word FROM w WHERE (start < 12 AND stop > 3) OR (start < 31 AND stop > 30)",
    "c08_cheap_pairs": _NEXT + f"SELECT doc_id, sentence_id FROM n WHERE {_ratio('text', 'next')} >= 0.25 AND {_jac('text', 'next')} >= 0.08",
    "a05_inverted_index": with_("s", r"i AS (SELECT doc_id, sentence_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_-]*'))) AS word FROM s)") + "SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM i GROUP BY word",
    "f17_kwic": with_("s", """k0 AS (SELECT doc_id, sentence_id, text, regexp_extract_all(text, '(?i)thing') AS ws, string_split_regex(text, '(?i)thing') AS gs FROM s),
  k1 AS (SELECT doc_id, sentence_id, text, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g FROM k0),
  k AS (SELECT *, (sum(length(g) + 5) OVER (PARTITION BY doc_id, sentence_id ORDER BY i))::BIGINT - 5 AS start FROM k1)""")
    + 'SELECT doc_id, sentence_id, start, substr(text, greatest(0, start - 20) + 1, start - greatest(0, start - 20)) AS "left", w AS keyword, substr(text, start + 6, 20) AS "right" FROM k',
    "h09_token_importance": with_("s", _W) + "SELECT doc_id, sentence_id, count(*) AS n, sum(length(word))::DOUBLE AS total, max(stop) AS last, sum(start)::BIGINT AS starts FROM w GROUP BY ALL",
    "f19_span_enumeration": with_("s", _W, _ENUM) + "SELECT * FROM e",
    "f03_ranked_spans": with_("s", _W, _ENUM, "k AS (SELECT doc_id, sentence_id, start, stop, importance, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY importance DESC, start, stop) AS rank FROM e)") + "SELECT * FROM k WHERE rank <= 8",
}
