"""Text queries: normalisation, cleaning, chunking, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import chunking as K
from quillspark.functions import spelling as S
from quillspark.functions import text as T
from quillspark.operators import claims as C
from quillspark.operators import jobs as J
from quillspark.operators import metrics as X
from quillspark.operators import pipeline as P
from quillspark.operators.trigrams import TrigramIndex
from quillspark.plans.registry import query

_MARKED = "'# ' || text || chr(13) || chr(10) || '* [a](b) `c`  ' || chr(10) || chr(10) || chr(10) || chr(10) || '> end'"


def marked(lib):
    text = F.concat(F.lit("# "), "text", F.lit("\r\n* [a](b) `c`  \n\n\n\n> end"))
    return lib.documents.select("doc_id", text.alias("text"))


@query("normalize_markdown", "", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def normalize_markdown(lib):
    return marked(lib).select("doc_id", F.md5(T.normalize_markdown(F.col("text"))).alias("digest"))


_S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: The markdown rules for an engine without back references: an alternative for each mark.
_RULES = (
    (r"\r\n?", "\n"), (r"(?m)^#{1,6}S+", ""), (r"(?m)^S*>+S?", ""), (r"(?m)^S*[-*+]S+", ""), (r"(?m)^S*\p{Nd}+[.)]S+", ""), (r"(?m)^(-{3,}|\*{3,}|_{3,})S*$", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"```([^`]+)```|``([^`]+)``|`([^`]+)`", r"\1\2\3"),
    (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"), (r"\*(.*?)\*|_(.*?)_", r"\1\2"), (r"\n{3,}", "\n\n"), (r"\AS+", ""), (r"S+\z", ""),
)


def _plain(text: str) -> str:
    for pattern, new in _RULES:
        text = f"regexp_replace({text}, '{pattern.replace('S', _S)}', '{new}', 'g')"
    return text


@query("strip_markdown", "", f"SELECT doc_id, md5({_plain(_MARKED)}) AS digest FROM documents")
def strip_markdown(lib):
    return marked(lib).select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("digest"))


@query("match_normalize", "", "SELECT doc_id, md5(translate(replace(replace(replace(text, 'e', chr(1744)), 'i', chr(1609)), 'y', chr(1610)), chr(1744) || chr(1609) || chr(1610), chr(1740) || chr(1740) || chr(1740))) AS digest FROM documents")
def match_normalize(lib):
    return lib.documents.select("doc_id", F.md5(T.match_form(F.translate("text", "eiy", "ېىي"))).alias("digest"))


@query("normalize_chars", "", "SELECT doc_id, md5(replace(replace(translate(text, 'abmn', chr(1575) || chr(1576)), 'k', chr(1574)), 'l', chr(1604) || chr(1575))) AS digest FROM documents")
def normalize_chars(lib):
    """Presentation forms (one of two letters), kashidas, joiners and hamza pairs in every text."""
    odd = F.replace(F.translate("text", "abmnkl", "\ufe8d\ufe90\u0640\u200c\u064a\ufefb"), F.lit("\u064a"), F.lit("\u064a\u0654"))
    return lib.documents.select("doc_id", F.md5(T.normalize(odd)).alias("digest"))


@query("clean_text")
def clean_text(lib):
    return lib.documents.select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("toc_pages", "", r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')), lambda x: x <> '') AS l FROM documents),
n AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x, '^\p{Nd}+|\p{Nd}+$')), lambda x: try_cast(regexp_extract(x, '^\p{Nd}+|\p{Nd}+$') AS HUGEINT)) AS n,
 len(list_filter(l, lambda x: regexp_matches(x, '^\|.*\|\s*\p{Nd}+\s*\|?$'))) AS tables, len(list_filter(l, lambda x: regexp_matches(x, '\.{6,}|_{6,}|-{6,}|·{6,}') AND regexp_matches(x, '^\p{Nd}+|\p{Nd}+$'))) AS dotted FROM l),
r AS (SELECT *, len(list_filter(range(1, len(n)), lambda i: coalesce(n[i + 1] >= n[i], false))) AS rising FROM n)
SELECT doc_id, contains(t, 'مۇندەرىجە') OR (tables >= 5 AND tables >= 0.5 * len(l)) OR (len(n) >= 5 AND dotted >= 3 AND rising >= 0.8 * (len(n) - 1) AND dotted >= 0.3 * len(l)) OR (dotted >= 5 AND dotted >= 0.5 * len(l)) AS is_toc FROM r""")
def toc_pages(lib):
    return lib.documents.select("doc_id", T.is_contents_page(F.col("text")).alias("is_toc"))


@query("citation_fix", "", """
SELECT conv_id, turn, text || chr(10) || 'see [book](ref:' || conv_id || ':45) then [Title of it، 3 بەت](ref:' || conv_id || ':3) [next](ref:1:2) or [مەنبە](ref:' || conv_id || ':12,13) here' AS text FROM conversations""")
def citation_fix(lib):
    """A nested link, one turned round, a whole one and a bare reference behind every text."""
    cited = F.concat("text", F.lit("\nsee [book]([مەنبە](ref:"), "conv_id", F.lit(":45)) then ref:"), "conv_id", F.lit("]بەت 3 ، Title of it [next](ref:1:2) or ref:"), "conv_id", F.lit(":12,13 here"))
    return lib.conversations.select("conv_id", "turn", T.fix_citations(cited).alias("text"))


@query("keyword_extract", "", "SELECT conv_id, turn, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')), lambda w: length(w) > 2)) AS INT) AS n FROM conversations")
def keyword_extract(lib):
    return lib.conversations.select("conv_id", "turn", F.size(T.keywords(F.col("text"))).alias("n"))


@query("summary_sample", "pages_v", """
SELECT book_id, md5(CASE WHEN length(t) <= 3000 THEN t ELSE substr(t, 1, 1200) || g || substr(t, CAST(length(t) // 2 - 300 + 1 AS BIGINT), 600) || g || substr(t, length(t) - 1200 + 1, 1200) END) AS digest
FROM (SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS t, chr(10) || chr(10) || '...' || chr(10) || chr(10) AS g FROM pages_v WHERE NOT is_toc AND text <> '' GROUP BY book_id)""")
def summary_sample(lib):
    return P.sampled_book_texts(lib.pages_v, 3000).select("book_id", F.md5("text").alias("digest"))


@query("chunk_documents")
def chunk_documents(lib):
    return K.chunk_table(lib.pages_v).select("book_id", "page_number", "chunk_index", F.md5("text").alias("digest"))


@query("chunk_counts")
def chunk_counts(lib):
    return K.chunk_table(lib.pages_v).groupBy("book_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("page_chunk_arrays")
def page_chunk_arrays(lib):
    return lib.pages_v.select("id", F.size(K.page_chunks(F.col("text"), F.col("is_toc"))).alias("n"))


@query("word_frequency", "words_v", "SELECT word, count(*) AS n FROM words_v GROUP BY word")
def word_frequency(lib):
    return X.word_frequency(lib.words_v)


@query("unknown_words", "words_v dictionary_v", "SELECT DISTINCT word FROM words_v EXCEPT SELECT word FROM dictionary_v")
def unknown_words(lib):
    return S.unknown_words(lib.words_v, lib.dictionary_v)


_VOWELS, _PAIRS = ("a", "e", "i", "o", "u"), (("n", "h"), ("h", "n"), ("r", "t"), ("e", "a"))


@query("ocr_corrections", "words_v dictionary_v", """
, d AS (SELECT DISTINCT word FROM dictionary_v), u AS (SELECT DISTINCT word FROM words_v WHERE word NOT IN (SELECT word FROM d)),
p AS (SELECT * FROM (VALUES (1, 'n', 'h'), (2, 'h', 'n'), (3, 'r', 't'), (4, 'e', 'a')) t(k, a, b)),
r1 AS (SELECT word, substr(word, 1, i - 1) || b || substr(word, i + 1) AS v, min(k * 1000 + i) AS o1 FROM u, p, range(1, 200) r(i) WHERE i <= length(word) AND substr(word, i, 1) = a GROUP BY 1, 2),
r2 AS (SELECT word, substr(v, 1, i - 1) || b || substr(v, i + 1) AS v, min(o1 * 10000 + k * 1000 + i) AS o FROM r1, p, range(1, 200) r(i) WHERE i <= length(v) AND substr(v, i, 1) = a GROUP BY 1, 2),
v AS (SELECT word, v AS variant, o1 AS place FROM r1 UNION ALL SELECT word, v, 1000000 + o FROM r2 WHERE v <> word
 UNION ALL SELECT word, substr(word, 1, i) || ['a', 'e', 'i', 'o', 'u'][k] || substr(word, i + 1), 1000000000 + i * 10 + k FROM u, range(0, 200) r(i), range(1, 6) s(k) WHERE i <= length(word)),
f AS (SELECT word, variant, min(place) AS place FROM v GROUP BY 1, 2)
SELECT word, string_agg(variant, ',' ORDER BY place) AS corrections FROM f WHERE variant IN (SELECT word FROM d) GROUP BY word""")
def ocr_corrections(lib):
    found = S.corrections(S.unknown_words(lib.words_v, lib.dictionary_v), lib.dictionary_v, _VOWELS, _PAIRS)
    return found.select("word", F.array_join("corrections", ",").alias("corrections"))


def arabic(lib):
    """Pages in Arabic letters, letter for letter, so that tokens and confusions occur."""
    return lib.texts_v.withColumn("text", F.translate(F.lower("text"), "abdefghiklmnorstu", "ابدەفگھىكلمنورستۇ"))


_ARABIC = "translate(lower(text), 'abdefghiklmnorstu', 'ابدەفگھىكلمنورستۇ')"


@query("tokenize_offsets", "pages_v", f"""
, w AS (SELECT id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS k, l FROM (SELECT id, regexp_extract_all({_ARABIC}, '[\u0621-\u06ff]+|[^\u0621-\u06ff]+') AS l FROM pages_v)),
o AS (SELECT id, w, coalesce(sum(length(w)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT id, w AS word, CAST(before AS INT) AS start, CAST(before + length(w) AS INT) AS "end" FROM o WHERE regexp_matches(w, '^[\u0621-\u06ff]') AND length(w) >= 4""")
def tokenize_offsets(lib):
    return S.token_rows(arabic(lib)).select(F.col("page_id").alias("id"), "word", "start", "end")


_LETTERS = "translate(word, 'abdefghiklmnorstu', 'ابدەفگھىكلمنورستۇ')"
_CONFUSED = ", ".join(f"('{a}', '{b}')" for a, b in S.CONFUSED)


@query("ocr_variants", "dictionary_v", f"""
, p AS (SELECT * FROM (VALUES {_CONFUSED}) t(a, b)), w AS (SELECT word, {_LETTERS} AS w FROM dictionary_v),
r1 AS (SELECT DISTINCT word, w, substr(w, 1, i - 1) || b || substr(w, i + 1) AS v FROM w, p, range(1, 200) r(i) WHERE i <= length(w) AND substr(w, i, 1) = a),
r2 AS (SELECT word, w, v FROM r1 UNION SELECT word, w, substr(v, 1, i - 1) || b || substr(v, i + 1) FROM r1, p, range(1, 200) r(i) WHERE i <= length(v) AND substr(v, i, 1) = a),
n AS (SELECT word, count(*) AS n FROM r2 WHERE v <> w GROUP BY word),
m AS (SELECT word, count(DISTINCT substr(w, 1, i) || v || substr(w, i + 1)) AS m FROM w, range(0, 200) r(i), (SELECT unnest([{", ".join(f"'{v}'" for v in S.VOWELS)}]) AS v) WHERE i <= length(w) GROUP BY word)
SELECT word, CAST(coalesce(n, 0) AS INT) AS n_replaced, CAST(m AS INT) AS n_inserted FROM m LEFT JOIN n USING (word)""")
def ocr_variants(lib):
    words = lib.dictionary_v.select("word", F.translate("word", "abdefghiklmnorstu", "ابدەفگھىكلمنورستۇ").alias("w"))
    return words.select("word", F.size(S.replaced(F.col("w"))).alias("n_replaced"), F.size(S.inserted(F.col("w"))).alias("n_inserted"))


@query("spell_check_pages", "pages_v dictionary_v", f"""
, d AS (SELECT DISTINCT {_LETTERS} AS word FROM dictionary_v), p AS (SELECT * FROM (VALUES {_CONFUSED}) t(a, b)),
w AS (SELECT id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, regexp_extract_all({_ARABIC}, '[\u0621-\u06ff]+|[^\u0621-\u06ff]+') AS l FROM pages_v)),
o AS (SELECT id, w AS word, coalesce(sum(length(w)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
t AS (SELECT * FROM o WHERE regexp_matches(word, '^[\u0621-\u06ff]') AND length(word) >= 4 AND word NOT IN (SELECT word FROM d)),
r1 AS (SELECT DISTINCT substr(word, 1, i - 1) || a || substr(word, i + 1) AS v FROM d, p, range(1, 200) r(i) WHERE i <= length(word) AND substr(word, i, 1) = b),
r2 AS (SELECT v FROM r1 UNION SELECT substr(v, 1, i - 1) || a || substr(v, i + 1) FROM r1, p, range(1, 200) r(i) WHERE i <= length(v) AND substr(v, i, 1) = b
 UNION SELECT substr(word, 1, i - 1) || substr(word, i + 1) FROM d, range(1, 200) r(i) WHERE i <= length(word) AND substr(word, i, 1) IN ({", ".join(f"'{v}'" for v in S.VOWELS)}))
SELECT id AS page_id, count(*) AS n, CAST(min(before) AS INT) AS first FROM t WHERE word IN (SELECT v FROM r2) GROUP BY id""")
def spell_check_pages(lib):
    arabic_words = lib.dictionary_v.select(F.translate("word", "abdefghiklmnorstu", "ابدەفگھىكلمنورستۇ").alias("word"))
    _, issues = S.check_pages(arabic(lib), arabic_words, [("خاتا", "توغرا")])
    return issues.groupBy("page_id").agg(F.count("*").alias("n"), F.min("char_offset").alias("first"))


#: Rules from the proverbs' words in Arabic letters: each gets an ending, so none is rewritten twice.
_ENDING = "ۇۇۇ"
_RULES = f"SELECT DISTINCT {_LETTERS} AS w FROM dictionary_v WHERE regexp_matches(word, '^[abdefghiklmnorstu]+$')"
_RUNS = f"SELECT id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, regexp_extract_all({_ARABIC}, '[\u0621-\u06ff]+|[^\u0621-\u06ff]+') AS l FROM pages_v)"


def arabic_rules(lib):
    word = F.translate("word", "abdefghiklmnorstu", "ابدەفگھىكلمنورستۇ")
    return lib.dictionary_v.where("word RLIKE '^[abdefghiklmnorstu]+$'").select(word.alias("misspelled_word"), F.concat(word, F.lit(_ENDING)).alias("corrected_word"))


def _texts_by(condition: str) -> str:
    return f""", d AS ({_RULES}), t AS ({_RUNS}),
m AS (SELECT id, string_agg(t.w || CASE WHEN d.w IS NOT NULL AND {condition} THEN '{_ENDING}' ELSE '' END, '' ORDER BY k) AS text, count(*) FILTER (WHERE d.w IS NOT NULL AND {condition}) AS n FROM t LEFT JOIN d ON d.w = t.w GROUP BY id)
SELECT p.id, md5(CASE WHEN p.text IS NOT NULL THEN coalesce(m.text, '') END) AS digest, CAST(coalesce(m.n, 0) AS INT) AS n FROM pages_v p LEFT JOIN m ON m.id = p.id"""


@query("rules_applied", "pages_v dictionary_v", _texts_by("true"))
def rules_applied(lib):
    from quillspark.functions.rewriting import rewritten

    marked = F.size(F.regexp_extract_all("text", F.lit(f"{_ENDING}(?![\u0621-\u06ff])"), 0))
    return rewritten(arabic(lib), arabic_rules(lib)).select("id", F.md5("text").alias("digest"), F.coalesce(marked, F.lit(0)).alias("n"))


@query("pages_corrected", "pages_v dictionary_v", _texts_by("length(t.w) >= 4 AND length(t.w) % 2 = 0"))
def pages_corrected(lib):
    """Issues at every word of four letters or more; active rules are those of words of even length."""
    found = S.token_rows(arabic(lib)).select((F.col("page_id") * 1_000_000 + F.col("start")).alias("id"), "page_id", "word", F.col("start").alias("char_offset"), F.col("end").alias("char_end"), F.lit("open").alias("status"))
    rules = arabic_rules(lib).withColumn("is_active", F.length("misspelled_word") % 2 == 0)
    return J.corrected_pages(arabic(lib), found, rules)[0].select("id", F.md5("text").alias("digest"), F.col("n_edits").alias("n"))


def issues(lib, processing: str | None = None):
    """An issue for every word of a page: (id, page_id, word, status), ids in order of arrival; a page's first of one word may be in processing."""
    rows = lib.texts_v.select(F.col("id").alias("page_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0).alias("words"))
    first = F.array_position("words", F.lit(processing)) - 1 if processing else F.lit(-1)
    rows = rows.select("page_id", first.alias("first"), F.posexplode("words").alias("pos", "w"))
    status = F.when(F.col("pos") == F.col("first"), "processing").when(F.col("pos") % 2 == 0, "open").otherwise("corrected")
    return rows.select((F.col("page_id") * 100000 + F.col("pos")).alias("id"), "page_id", F.col("w").alias("word"), status.alias("status"))


_ISSUES = """i AS (SELECT page_id * 100000 + pos AS id, page_id, w AS word, CASE WHEN pos % 2 = 0 THEN 'open' ELSE 'corrected' END AS status
 FROM (SELECT id AS page_id, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]{4,}') AS l FROM pages_v)))"""


@query("spell_summary_by_page", "pages_v", f", {_ISSUES} SELECT book_id, page_number, n, n_open, CAST(sum(n) OVER (PARTITION BY book_id) AS BIGINT) AS book_n FROM (SELECT p.book_id, p.page_number, count(i.id) AS n, count(*) FILTER (WHERE i.status = 'open') AS n_open FROM pages_v p LEFT JOIN i ON i.page_id = p.id GROUP BY 1, 2)")
def spell_summary_by_page(lib):
    return X.spelling_summary(lib.pages_v, issues(lib))


@query("auto_correct_stats", "pages_v rules_v", f", {_ISSUES} SELECT (SELECT count(*) FROM rules_v) AS rules, (SELECT count(*) FROM rules_v WHERE is_active) AS active_rules, (SELECT count(*) FROM i WHERE status = 'open') AS open_issues, (SELECT count(DISTINCT id) FROM i JOIN rules_v r ON r.misspelled_word = i.word WHERE r.is_active AND i.status = 'open') AS correctable")
def auto_correct_stats(lib):
    return X.auto_correct_stats(issues(lib), lib.rules_v)


@query("autocorrect_claim", "pages_v rules_v", f""", {_ISSUES}, c AS (SELECT id, page_id FROM i JOIN rules_v r ON r.misspelled_word = i.word WHERE r.is_active AND i.status = 'open'),
f AS (SELECT page_id, min(id) AS first FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first) AS nth FROM f)
SELECT c.id, c.page_id FROM c JOIN r USING (page_id) WHERE r.nth <= 20 AND c.id < coalesce((SELECT first FROM r WHERE nth = 21), 9223372036854775807)""")
def autocorrect_claim(lib):
    return X.correctable_claims(issues(lib), lib.rules_v, 20)


@query("book_issue_pages_json", "books_v pages_v", """
SELECT b.id, '[' || coalesce(string_agg(p.page_number, ',' ORDER BY p.page_number), '') || ']' AS pages, CAST(coalesce(min(p.page_number), 1) AS INT) AS first_page
FROM books_v b LEFT JOIN (SELECT book_id, page_number FROM pages_v WHERE spell_check_milestone = 'failed') p ON p.book_id = b.id GROUP BY b.id""")
def book_issue_pages_json(lib):
    return X.pages_with_issues(lib.books_v, lib.pages_v.where("spell_check_milestone = 'failed'"))


@query("apply_edits", "pages_v", """
SELECT id, md5(CASE WHEN id % 3 = 0 AND length(text) > 12 THEN substr(text, 1, 4) || 'NEW' || substr(text, 9) ELSE text END) AS digest, CAST(CASE WHEN id % 3 = 0 AND length(text) > 12 THEN 1 ELSE 0 END AS INT) AS n_edits FROM pages_v""")
def apply_edits(lib):
    edits = lib.pages_v.where("id % 3 = 0 AND length(text) > 12").select(F.col("id").alias("page_id"), F.lit(4).alias("start"), F.lit(8).alias("end"), F.lit("NEW").alias("new"))
    return S.apply_edits(lib.pages_v, edits).select("id", F.md5("text").alias("digest"), "n_edits")


@query("prefix_issue_counts", "pages_v", "SELECT id, CAST(coalesce(sum(retry_count) OVER (PARTITION BY book_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM pages_v")
def prefix_issue_counts(lib):
    return X.issues_before(lib.pages_v, "retry_count").select("id", "before")


@query("issue_word_context", "pages_v", "SELECT id, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 8), ' ') AS context FROM pages_v")
def issue_word_context(lib):
    return lib.texts_v.select("id", X.word_context(F.col("text"), F.lit(2), 5).alias("context"))


@query("file_titles", "pages_v", "SELECT id, 'Vol. ' || page_number AS title, 'c-' || id || '.jpg' AS cover FROM pages_v")
def file_titles(lib):
    path = F.concat(F.lit("uploads/Vol. "), "page_number", F.lit(".pdf"))
    return lib.pages_v.select("id", T.title_of_file(path).alias("title"), T.cover_path(F.concat(F.lit("https://x/covers/c-"), "id", F.lit(".jpg?v=1"))).alias("cover"))


_CLAIMABLE = f"""{_ISSUES}, s AS (SELECT *, CASE WHEN id % 11 <> 5 THEN CAST(id % 100000 * 7 AS INT) END AS char_offset, CASE WHEN id % 13 <> 5 THEN CAST(id % 100000 * 7 + 4 AS INT) END AS char_end FROM i)"""


def _placed_issues(lib):
    place = (F.col("id") % 100000 * 7).cast("int")
    return issues(lib).withColumns({"char_offset": F.when(F.col("id") % 11 != 5, place), "char_end": F.when(F.col("id") % 13 != 5, place + 4), "claimed_at": F.lit(None).cast("timestamp_ntz")})


@query("issues_claimed", "pages_v rules_v", f""", {_CLAIMABLE},
c AS (SELECT s.id, s.page_id FROM s JOIN rules_v r ON r.misspelled_word = s.word WHERE r.is_active AND s.status = 'open' AND char_offset IS NOT NULL AND char_end IS NOT NULL ORDER BY s.id LIMIT 200),
f AS (SELECT page_id, min(id) AS first FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first) AS nth FROM f),
t AS (SELECT c.id FROM c JOIN r USING (page_id) WHERE r.nth <= 20 AND c.id < coalesce((SELECT first FROM r WHERE nth = 21), 9223372036854775807))
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'processing' ELSE status END AS status, id IN (SELECT id FROM t) AS claimed FROM s""")
def issues_claimed(lib):
    found = C.issues_claimed(_placed_issues(lib), lib.rules_v, 20, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return found.select("id", "status", F.col("claimed_at").isNotNull().alias("claimed"))


@query("issues_released", "pages_v", f""", {_ISSUES}
SELECT id, CASE WHEN id % 3 = 0 AND id % 40 > 15 THEN 'open' WHEN id % 3 = 0 THEN 'processing' ELSE status END AS status, (id % 3 = 0 AND id % 40 <= 15) AS claimed FROM i""")
def issues_released(lib):
    at = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    held = F.col("id") % 3 == 0
    rows = issues(lib).withColumns({"status": F.when(held, "processing").otherwise(F.col("status")), "claimed_at": F.when(held, at - F.expr("make_dt_interval(0, 0, CAST(id % 40 AS INT), 0)"))})
    return C.issues_released(rows, at).select("id", "status", F.col("claimed_at").isNotNull().alias("claimed"))


#: Patterns of the indexed searches: wildcards, then regular expressions.
_LIKES = ("%ther the%", "%IDIOT%", "%an_heu%", "%ciónm%", "%a%")
_EXPRESSIONS = ("clown|worthless", "(?i)(secret|token) ?[=:] ?[a-z0-9]", "\\bth(at|is|e) (and|for)\\b", "[0-9]{3}-[0-9]{2}", "unge?heit")
_SEARCHED = " UNION ALL ".join([f"SELECT {k} AS pattern, id FROM pages_v WHERE text ILIKE '{p}'" for k, p in enumerate(_LIKES)] + [f"SELECT {10 + k} AS pattern, id FROM pages_v WHERE regexp_matches(text, '{p}')" for k, p in enumerate(_EXPRESSIONS)])


@query("texts_by_trigrams", "pages_v", _SEARCHED)
def texts_by_trigrams(lib):
    pages = lib.texts_v.select("id", "text")
    index = TrigramIndex.build(pages)
    return index.matches(pages, dict(enumerate(_LIKES)), dict(enumerate(_EXPRESSIONS, 10))).select("pattern", "id")
