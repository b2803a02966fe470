"""Text expressions: normalising, sentences, tokens, n-grams, mentions, highlights, identifiers. Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates sentences; spelled out, as engines differ on \s.
WS = r"[ \t\n\r\f]"
TOKEN = r"[\p{L}\p{N}_]+"
GRAM_JOIN = "§"
_MARK = "\x01"

# --- fixed values -------------------------------------------------------------------------------------------------------
#: Journal names whose short lines are headers.
HEADER_LINES = ("Discover Sustainability", "Research")
PRONOUNS = (
    "he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs", "we", "us", "i", "you", "yours", "mine", "ours",
    "himself", "herself", "itself", "ourselves", "themselves", "yourself", "yourselves", "myself",
)
SHORT_PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs")
EVIDENCE_LEVELS = ((0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate"))
# -------------------------------------------------------------------------------------------------------------------------


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], F.lit(s[1])), steps, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


#: Numbers that are summed at once.
_RUN = 128


def sums_before(values: Column) -> Column:
    """Of array<int>, the sum of the values before each; in time that goes with their number.

    A fold that makes an array copies it at each step. So only runs of bounded length are folded, and the sums of runs, and
    of runs of runs, are added on top.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    fold = lambda v: F.aggregate(v, start, step, lambda a: a["out"])
    runs = lambda v: F.sequence(F.lit(0), F.ceil(F.size(v) / _RUN).cast("int") - 1)
    run = lambda v, k: F.slice(v, k * _RUN + 1, F.lit(_RUN))
    totals = lambda v: F.transform(runs(v), lambda k: F.aggregate(run(v, k), F.lit(0), lambda a, x: a + x))
    above = lambda v, sums: F.flatten(F.transform(runs(v), lambda k: let(F.get(sums, k), lambda s: F.transform(fold(run(v, k)), lambda x: x + s))))

    def by_runs(v: Column, inner) -> Column:
        return F.when(F.size(v) <= _RUN, fold(v)).otherwise(let(let(totals(v), inner), lambda sums: above(v, sums)))

    return let(values, lambda v: by_runs(v, lambda t: by_runs(t, fold)))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>>: leftmost matches, apart, in code points, end exclusive.

    The pieces between matches and the matches themselves add up to the text, so sums of their lengths are the offsets. The
    pattern must not match the empty string.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(f: Column) -> Column:
        sizes = F.zip_with(f["m"], F.slice(f["p"], F.lit(1), F.size(f["m"])), lambda m, p: F.length(p) + F.length(m))
        end = lambda at, p: at + F.length(p)
        return let(sums_before(sizes), lambda at: F.transform(f["m"], lambda m, i: let(end(F.get(at, i), F.get(f["p"], i)), lambda a: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("match")))))

    return let(found, placed)


def paragraphs(text: Column) -> Column:
    """The paragraphs of extracted text: hyphenation at line ends undone, blanks collapsed, scraps dropped."""
    joined = _chain(text, (r"-[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*", ""), (r"\n[ \t\n\x0B\f\r]*\n+", _MARK), (r"\n+", " "), (r"[ \t]+", " "))
    parts = F.transform(F.split(strip(joined), _MARK), strip)
    return F.filter(parts, lambda p: (F.length(p) >= 20) & ~p.rlike("^[0-9]+$"))


def normalised(text: Column, most: int | None = None) -> Column:
    """paragraphs() joined by blank lines, cut at the last full stop near `most`, if that is given."""
    whole = F.array_join(paragraphs(text), "\n\n")
    if not most:
        return whole

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, most)
        stop = F.when(F.instr(head, ".") > 0, F.length(head) - F.instr(F.reverse(head), ".") + 1).otherwise(0)
        return F.when(F.length(t) <= most, t).otherwise(strip(F.when(stop - 1 > most * 0.8, F.substring(head, F.lit(1), stop)).otherwise(head)))

    return let(whole, cut)


def without_citations(text: Column) -> Column:
    """Bracketed citations, superscripts and parenthesised numbers go; spaces are tidied."""
    return strip(
        _chain(
            text,
            (r"\[\d+(?:[,\-]\s*\d+)*\]", ""),
            (r"\[[\w\s]+et al\.,?\s*\d{4}\]", ""),
            (r"\[[\w\s]+,?\s*\d{4}\]", ""),
            (r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+", ""),
            (r"\((\d+(?:,\s*\d+)*)\)(?!\s*\d{3})", ""),
            (r"\s+", " "),
            (r"\s+([.,;:!?])", "$1"),
        )
    )


def without_artifacts(text: Column, aggressive: bool = False) -> Column:
    """Header and footer lines, inline DOIs and volume marks go; blank lines are collapsed."""

    def header(s: Column) -> Column:
        return (F.length(s) > 0) & (F.length(s) < 80) & (s.rlike(r"^Vol\.:?\(?\d+\)") | s.rlike(r"^https?://doi\.org/") | s.rlike(r"^©\s*\d{4}") | s.isin(*HEADER_LINES))

    inline = [(r"https?://doi\.org/[\S]+", ""), (r"Vol\.:?\(?\d+\)", "")] + [(r"©\s*The\s+Author\(s\)\s*\d{4}", "")] * aggressive
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~header(strip(line)))
    return _chain(F.array_join(F.transform(kept, lambda line: _chain(line, *inline)), "\n"), (r"\n\s*\n\s*\n+", "\n\n"))


def sentence_texts(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"([.!?]){WS}+", "$1" + _MARK), _MARK, -1)


def sentence_spans(text: Column) -> Column:
    """array<struct<start,end,text>> in code points, end exclusive, a place for each sentence, empty ones too."""
    gaps = F.transform(F.regexp_extract_all(text, F.lit(rf"[.!?]({WS}+)"), F.lit(1)), F.length)

    def placed(s: Column) -> Column:
        return let(sums_before(F.zip_with(s["s"], s["g"], lambda t, g: F.length(t) + F.coalesce(g, F.lit(0)))), lambda at: F.transform(s["s"], lambda t, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(t)).alias("end"), t.alias("text"))))

    return let(F.struct(sentence_texts(text).alias("s"), gaps.alias("g")), placed)


def claims(text: Column) -> Column:
    """What [.!?] separates, stripped, if longer than ten characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+", -1), strip), lambda s: F.length(s) > 10)


def prepared(text: Column) -> Column:
    """Lower-case words with one space between them, without backticks and double quotes."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.lower), " "), '[`"]', ""))


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column, stop: tuple[str, ...] = (), lemma=None) -> Column:
    """tokens() without stop words; lemma is a plug-in, Column to Column, and the identity by default."""
    out = F.filter(tokens(text), lambda t: ~t.isin(*stop)) if stop else tokens(text)
    return F.transform(out, lemma) if lemma else out


def heads(text: Column) -> Column:
    """The default head of a mention is its last token."""
    return let(tokens(text), lambda t: F.slice(t, F.greatest(F.size(t), F.lit(1)), F.lit(1)))


def character_runs(text: Column, n: int) -> Column:
    """Each run of n characters; of single characters first, as a place within a long text is found by counting from its
    beginning."""
    runs = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))
    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), runs)


def char_grams(text: Column, n: int = 4) -> Column:
    """Of the lower-case text with single spaces and without punctuation, each run of n characters."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " ")), r"[^\p{L}\p{N}_ ]+", "")
    return character_runs(clean, n)


def plain_char_grams(text: Column, n: int = 4) -> Column:
    """B10, the variant that keeps punctuation."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))
    return character_runs(clean, n)


def token_grams(words: Column, n: int) -> Column:
    """N consecutive tokens, joined."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), GRAM_JOIN))).otherwise(F.array().cast("array<string>"))


def grams(text: Column, token_ns: tuple[int, ...] = (2, 3), char_n: int = 4) -> Column:
    """Token n-grams, character n-grams and heads, with repeats."""
    return let(tokens(text), lambda w: F.concat(*[token_grams(w, n) for n in token_ns], char_grams(text, char_n), F.slice(w, F.greatest(F.size(w), F.lit(1)), F.lit(1))))


def mention_key(text: Column) -> Column:
    """Lower case, single spaces, stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def trimmed_mention(text: Column) -> Column:
    """Stripped of surrounding punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), r"^[.,;:!?\"'()\[\]{} ]+|[.,;:!?\"'()\[\]{} ]+$", "")


def pronoun_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "")


def is_pronoun(text: Column) -> Column:
    """B14"""
    return pronoun_key(text).isin(*PRONOUNS)


def is_pronoun_mention(text: Column) -> Column:
    """A mention that is a pronoun but for punctuation about it. Letters other than a-z and spaces within it count,
    so that no longer mention whose letters a-z happen to spell a pronoun is taken for one."""
    return trimmed_mention(F.lower(F.coalesce(text, F.lit("")))).isin(*PRONOUNS)


def is_short_pronoun(text: Column) -> Column:
    """B14, the variant that only strips and lower-cases."""
    return F.lower(F.trim(text)).isin(*SHORT_PRONOUNS)


def edge_tag(antecedent: Column, anaphor: Column) -> Column:
    """How a mention refers to the one before."""
    a, b = strip(F.coalesce(antecedent, F.lit(""))), strip(F.coalesce(anaphor, F.lit("")))
    both = is_pronoun(a) & is_pronoun(b)
    return (
        F.when(both & (pronoun_key(a) == pronoun_key(b)), "PRON-PRON-C")
        .when(both, "PRON-PRON-NC")
        .when((a != "") & (a == b), "MATCH")
        .when((a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b)), "CONTAINS")
        .when(~is_pronoun(a) & is_pronoun(b), "ENT-PRON")
        .otherwise("OTHER")
    )


def relation(first: Column, second: Column) -> Column:
    """B15, the heuristic without regard to case."""
    a, b = F.lower(first), F.lower(second)
    return F.when(a == b, "MATCH").when(F.contains(b, a) | F.contains(a, b), "CONTAINS").when(is_short_pronoun(a) | is_short_pronoun(b), "ENT_PRON").otherwise("OTHER")


def representative(mentions: Column) -> Column:
    """Of array<struct<text,is_pronoun>>, the longest text, of those that are no pronouns if there are any; the first
    of equals."""
    ranked = F.transform(mentions, lambda m, i: F.struct((~m["is_pronoun"]).alias("full"), F.length(m["text"]).alias("n"), (-i).alias("at"), m["text"].alias("text")))
    return F.array_max(ranked)["text"]


def spaced(words: Column) -> Column:
    """Words joined by spaces, but for those before closing and after opening punctuation."""
    return F.regexp_replace(F.regexp_replace(F.array_join(words, " "), r" +([.,;:!?)\]}])", "$1"), r"([(\[{]) +", "$1")


def phrase_query(phrases: Column) -> Column:
    """Each different phrase in double quotes, in order."""
    return F.array_join(F.transform(F.array_distinct(phrases), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " ")


def preview(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where more are left out."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def escaped(term: str) -> str:
    """The term as a pattern of itself, for both Java and RE2."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in term)


def bold(text: Column, terms: list[str]) -> Column:
    """Whole words among the terms in <b>; the longest term first, and no term within another."""
    if not terms:
        return text
    alternatives = "|".join(escaped(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)\b({alternatives})\b", "<b>$1</b>")


def highlighted(text: Column, spans: Column) -> Column:
    """Spans (array<struct<start,end>>, apart) of the text in <mark>."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<mark>"), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("</mark>")).alias("out"), s["end"].alias("at"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def kwic(text: Column, start: Column, end: Column, width: int) -> Column:
    """struct<left,keyword,right>, with at most width characters on each side."""
    first = F.greatest(F.lit(0), start - width)
    return F.struct(
        F.substring(text, first + 1, start - first).alias("left"),
        F.substring(text, start + 1, end - start).alias("keyword"),
        F.substring(text, end + 1, F.lit(width)).alias("right"),
    )


def doi(url: Column) -> Column:
    """The first DOI, without full stops at its end; null if there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(url, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0), F.lit(".")), F.lit(""))


def urls(text: Column) -> Column:
    """All URLs, without punctuation at their ends, with a repeated DOI prefix taken once."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s\])>\"'<]+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"[.,;:]+$", ""), r"^(https?://doi\.org/)(?:https?://doi\.org/)+", "$1"))


def doi_list(value: Column) -> Column:
    """A JSON list, or values between commas. Text is never evaluated."""
    parsed = F.from_json(F.when(strip(value).startswith("["), strip(value)), "array<string>")
    listed = F.filter(F.transform(F.split(F.regexp_replace(value, r"[\[\]'\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, listed))


def doi_variants(value: Column) -> Column:
    """The names under which a file may hold a DOI, each once."""
    d = F.trim(value)
    return F.filter(
        F.array_distinct(F.array(d, F.replace(d, F.lit("/"), F.lit("_")), F.replace(d, F.lit("/"), F.lit("-")), F.translate(d, "./", "__"), F.regexp_replace(d, "[^0-9A-Za-z]+", "_"), F.element_at(F.split(d, "/"), -1))),
        lambda x: x != "",
    )


def file_key(name: Column) -> Column:
    """What is left of a file name after its DOI or site prefix, in lower case, with single full stops."""
    stem = F.regexp_replace(F.lower(F.trim(name)), r"\.pdf$", "")
    after = F.when(F.contains(stem, F.lit("doi.org.")), F.regexp_replace(F.regexp_replace(stem, r"^.*?doi\.org\.", ""), r"^(?:doi\.org\.)+", "")).when(F.contains(stem, F.lit("www.iea.org.")), F.regexp_replace(F.regexp_replace(stem, r"^.*?www\.iea\.org\.", ""), r"^(?:doi\.org\.)+", ""))
    return F.regexp_replace(F.coalesce(after, stem), r"\.{2,}", ".")


def rtrimmed(text: Column) -> Column:
    """B37"""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+$", "")


def fingerprint(*attributes: Column) -> Column:
    """B37"""
    return F.sha1(F.concat_ws("|", *attributes))


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter over the longer text, each at least one long."""
    x, y = F.greatest(F.length(a), F.lit(1)), F.greatest(F.length(b), F.lit(1))
    return F.least(x, y) / F.greatest(x, y)


def words(text: Column) -> Column:
    """Lower-case words between white space, without empty ones."""
    return F.filter(F.split(F.lower(text), WS + "+"), lambda w: w != "")


def term_words(listed: Column) -> Column:
    """Of tokens, those that are terms: no special tokens in brackets, no word pieces, no single characters, no
    punctuation."""
    return F.filter(listed, lambda w: ~w.rlike(r"^\[.*\]$") & ~w.startswith("##") & (F.length(w) > 1) & ~w.rlike(r"^[\p{P}\p{S}]+$"))


def scored_terms(items: Column, least: float = 0.1) -> Column:
    """Of keyphrases (array<struct<text,score>>), those without a score, or with one of `least` or more."""
    return F.filter(items, lambda x: x["score"].isNull() | (x["score"] >= least))


def word_jaccard(a: Column, b: Column) -> Column:
    """Of the word sets; 0 if either is empty."""
    return set_jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def set_jaccard(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def strength(score: Column) -> Column:
    """B35"""
    out = F.when(score >= EVIDENCE_LEVELS[0][0], EVIDENCE_LEVELS[0][1])
    for least, name in EVIDENCE_LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Weak")


def resolved(text: Column, replacements: Column) -> Column:
    """Replacements (array<struct<start,end,by>>, offsets in the text) made from right to left; bad ones are skipped."""
    fine = F.filter(replacements, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= F.length(text)))
    return F.aggregate(F.sort_array(fine, asc=False), text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["by"], F.substring(t, r["end"] + 1, F.length(t))))


def alignment(text: Column, replacements: Column) -> Column:
    """array<struct<orig_start,orig_end,res_start,res_end>> of replaced and untouched parts, from left to right.

    replacements: array<struct<start,end,by>>, apart, in order of start.
    """
    kind = "array<struct<orig_start:int,orig_end:int,res_start:int,res_end:int>>"
    part = lambda a, b, c, d: F.array(F.struct(a.alias("orig_start"), b.alias("orig_end"), c.alias("res_start"), d.alias("res_end")))
    none = F.array().cast(kind)
    zero = F.struct(F.lit(0).alias("o"), F.lit(0).alias("r"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = x["start"] - a["o"]
        at = a["r"] + gap
        kept = F.when(gap > 0, part(a["o"], x["start"], a["r"], at)).otherwise(none)
        return F.struct(x["end"].alias("o"), (at + F.length(x["by"])).alias("r"), F.concat(a["out"], kept, part(x["start"], x["end"], at, at + F.length(x["by"]))).alias("out"))

    def tail(a: Column) -> Column:
        left = F.length(text) - a["o"]
        return F.concat(a["out"], F.when(left > 0, part(a["o"], F.length(text), a["r"], a["r"] + left)).otherwise(none))

    return F.aggregate(F.sort_array(replacements), zero, step, tail)
