"""Vector and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.operators import retrieval as R
from quillspark.operators import vectors as V
from quillspark.operators.vector_index import VectorIndex
from quillspark.plans.catalog_queries import shelf
from quillspark.plans.registry import query

K, THRESHOLD = 16, 0.15
_Q = ", q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
_SIM = "list_cosine_similarity({0}.embedding::DOUBLE[], q.qv::DOUBLE[])"
_CHUNKS = f"""SELECT c.id, c.book_id, c.page_number, b.title, round({_SIM.format('c')}, 6) AS similarity
FROM chunks_v c JOIN books_v b ON c.book_id = b.id JOIN pages_v p ON c.book_id = p.book_id AND c.page_number = p.page_number CROSS JOIN q
WHERE NOT p.is_toc AND {_SIM.format('c')} > {{0}} {{1}} ORDER BY {_SIM.format('c')} DESC, c.id LIMIT {{2}}"""


def question(lib):
    """The query vector: one bounded row, as literals."""
    return V.query_vector(lib.embeddings.where("vec_id = 0").select("embedding").first()[0])


def _found(df):
    return df.select("id", "book_id", "page_number", "title", F.round("similarity", 6).alias("similarity"))


@query("chunk_similarity_topk", "chunks_v books_v pages_v", _Q + _CHUNKS.format(THRESHOLD, "", K))
def chunk_similarity_topk(lib):
    return _found(V.chunk_search(lib.chunks_v, shelf(lib), lib.pages_v, question(lib), k=K, threshold=THRESHOLD))


@query("chunk_similarity_scoped", "chunks_v books_v pages_v", _Q + _CHUNKS.format(-1, "AND c.book_id IN ('src1', 'src2', 'src3', 'src5') AND list_has_any([b.cat1, b.cat2], ['poetry'])", 12))
def chunk_similarity_scoped(lib):
    return _found(V.chunk_search(lib.chunks_v, shelf(lib), lib.pages_v, question(lib), ["src1", "src2", "src3", "src5"], ["poetry"], 12, -1.0))


@query("chunk_search_indexed", "chunks_v books_v pages_v", _Q + _CHUNKS.format(THRESHOLD, "", K))
def chunk_search_indexed(lib):
    values = lib.embeddings.where("vec_id = 0").select("embedding").first()[0]
    index = VectorIndex.build(lib.chunks_v)
    return _found(V.chunk_search(index.above(values, THRESHOLD), shelf(lib), lib.pages_v, V.query_vector(values), k=K, threshold=THRESHOLD))


@query("vector_index_topk", "", f"""
SELECT query_id, id, similarity, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 20 = 0) WHERE rank <= {K}""")
def vector_index_topk(lib):
    index = VectorIndex.build(lib.embeddings, "vec_id")
    found = index.search(lib.embeddings.where("vec_id % 20 = 0"), K, exact=True, key="vec_id")
    return found.select(F.col("vec_id").alias("query_id"), "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_SUMMARIES = _Q + f"SELECT s.book_id, round({_SIM.format('s')}, 6) AS similarity FROM summaries_v s JOIN books_v b ON b.id = s.book_id CROSS JOIN q WHERE list_has_any([b.cat1, b.cat2], ['novel', 'poetry']) AND {_SIM.format('s')} > -0.5 ORDER BY {_SIM.format('s')} DESC, s.book_id LIMIT 8"


@query("summary_search", "summaries_v books_v", _SUMMARIES)
def summary_search(lib):
    found = V.summary_search(lib.summaries_v, shelf(lib), question(lib), ["novel", "poetry"], k=8, threshold=-0.5)
    return found.select("book_id", F.round("similarity", 6).alias("similarity"))


@query("summary_search_indexed", "summaries_v books_v", _SUMMARIES)
def summary_search_indexed(lib):
    values = lib.embeddings.where("vec_id = 0").select("embedding").first()[0]
    index = VectorIndex.build(lib.summaries_v, "book_id")
    found = V.summary_search(index.above(values, -0.5), shelf(lib), V.query_vector(values), ["novel", "poetry"], k=8, threshold=-0.5)
    return found.select("book_id", F.round("similarity", 6).alias("similarity"))


@query("hierarchical_retrieval", "summaries_v chunks_v books_v pages_v", _Q + f", top AS (SELECT s.book_id FROM summaries_v s CROSS JOIN q WHERE {_SIM.format('s')} > -0.5 ORDER BY {_SIM.format('s')} DESC, s.book_id LIMIT 5) " + _CHUNKS.format(-0.5, "AND c.book_id IN (SELECT book_id FROM top)", 10))
def hierarchical_retrieval(lib):
    return _found(V.hierarchical_search(lib.summaries_v, lib.chunks_v, shelf(lib), lib.pages_v, question(lib), 5, -0.5, 10, -0.5))


@query("cosine_by_label", "", """
SELECT a.label, count(*) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN (SELECT label, embedding FROM embeddings e WHERE vec_id = (SELECT min(vec_id) FROM embeddings f WHERE f.label = e.label)) c ON c.label = a.label GROUP BY a.label""")
def cosine_by_label(lib):
    first = lib.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return lib.embeddings.join(first, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine(F.col("embedding"), F.col("c"))), 6).alias("similarity"))


_OBSERVED = "SELECT label AS query_id, id % 4 AS obs_idx, id AS chunk_idx, book_id, page_number, CAST((id * 37) % 101 AS DOUBLE) / 100 AS score, 'chunk ' || id AS text FROM chunks_v"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, obs_idx, chunk_idx) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, book_id, page_number ORDER BY obs_idx, chunk_idx) AS seen FROM ({_OBSERVED})) WHERE seen = 1"


def observed(lib):
    score = ((F.col("id") * 37) % 101).cast("double") / 100
    return lib.chunks_v.select(F.col("label").alias("query_id"), (F.col("id") % 4).alias("obs_idx"), F.col("id").alias("chunk_idx"), "book_id", "page_number", score.alias("score"), F.concat(F.lit("chunk "), "id").alias("text"))


@query("context_ranking", "chunks_v", f"SELECT query_id, chunk_idx, rank FROM ({_RANKED}) WHERE rank <= 15")
def context_ranking(lib):
    return R.ranked_context(observed(lib)).select("query_id", "chunk_idx", F.col("rank").cast("long").alias("rank"))


@query("context_assembly", "chunks_v", f"SELECT query_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, count(DISTINCT book_id) AS books FROM ({_RANKED}) WHERE rank <= 15 GROUP BY query_id")
def context_assembly(lib):
    whole = R.assembled_context(R.ranked_context(observed(lib)))
    return whole.select("query_id", F.md5("context").alias("digest"), F.size("book_ids").cast("long").alias("books"))


_TOOLS = "SELECT label AS query_id, id % 4 + 1 AS step, CASE id % 3 WHEN 0 THEN 'search_chunks' WHEN 1 THEN 'get_summary' ELSE 'search_summaries' END AS tool FROM chunks_v"


@query("retrieval_metrics", "chunks_v", f"""
SELECT t.query_id, coalesce(c.n, 0) AS n_chunks, round(coalesce(c.s, 0), 6) AS mean_score, coalesce(c.digest, md5('')) AS scores, t.n_steps, t.tools, t.n_searches, coalesce(f.n, 0) AS n_final FROM
 (SELECT query_id, max(step) AS n_steps, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(*) FILTER (WHERE starts_with(tool, 'search')) AS n_searches FROM ({_TOOLS}) GROUP BY 1) t
 LEFT JOIN (SELECT query_id, count(*) AS n, avg(score) AS s, md5(string_agg(CAST(round(score * 100) AS INT), ',' ORDER BY obs_idx, chunk_idx)) AS digest FROM ({_OBSERVED}) GROUP BY 1) c USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_RANKED}) WHERE rank <= 15 GROUP BY 1) f USING (query_id)""")
def retrieval_metrics(lib):
    tool = F.when(F.col("id") % 3 == 0, "search_chunks").when(F.col("id") % 3 == 1, "get_summary").otherwise("search_summaries")
    tools = lib.chunks_v.select(F.col("label").alias("query_id"), (F.col("id") % 4 + 1).alias("step"), tool.alias("tool"))
    return R.retrieval_metrics(observed(lib), tools).withColumns({"mean_score": F.round("mean_score", 6), "scores": F.md5(F.array_join(F.transform("scores", lambda x: F.round(x * 100).cast("int")), ","))})


@query("agent_steps", "chunks_v", """
SELECT query_id, step FROM (SELECT *, coalesce(sum(n_chunks) OVER w, 0) AS so_far, coalesce(sum(CASE WHEN n_calls = 0 THEN 1 ELSE 0 END) OVER w, 0) AS idle
 FROM (SELECT id AS query_id, unnest([1, 2, 3, 4, 5, 6]) AS step, (id + unnest([1, 2, 3, 4, 5, 6])) % 7 AS n_calls, (id * unnest([1, 2, 3, 4, 5, 6])) % 5 AS n_chunks FROM chunks_v)
 WINDOW w AS (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE so_far < 8 AND idle = 0 AND step <= 4""")
def agent_steps(lib):
    steps = lib.chunks_v.select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, range(1, 7)))).alias("step"))
    steps = steps.withColumns({"n_calls": (F.col("query_id") + F.col("step")) % 7, "n_chunks": (F.col("query_id") * F.col("step")) % 5})
    return R.steps_taken(steps).select("query_id", "step")


def questions(lib):
    """Questions about titles and authors, from conversations."""
    ask = F.concat(F.lit("who wrote Work"), F.when(F.col("turn") % 2 == 0, "").otherwise("s"), F.lit(" "), F.col("conv_id") % 7, F.lit(" by Author "), F.col("turn") % 4, F.lit("?"))
    return lib.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), ask.alias("question"))


_QUESTIONS = "SELECT conv_id * 1000 + turn AS question_id, 'who wrote Work' || CASE WHEN turn % 2 = 0 THEN '' ELSE 's' END || ' ' || (conv_id % 7) || ' by Author ' || (turn % 4) || '?' AS question FROM conversations"
_IN = "len(list_filter(string_split({0}, ' '), lambda w: NOT len(list_filter(string_split(trim(q.question, '?'), ' '), lambda x: starts_with(x, w))) > 0)) = 0"


@query("entity_title_match", "books_v", f", q AS ({_QUESTIONS}) SELECT question_id, min(title) AS title FROM q JOIN (SELECT DISTINCT title FROM books_v) b ON {_IN.format('b.title')} GROUP BY 1")
def entity_title_match(lib):
    return R.titles_in(questions(lib), lib.books_v)


@query("author_by_title", "books_v", f", q AS ({_QUESTIONS}) SELECT t.question_id, t.title, a.author FROM (SELECT question_id, min(title) AS title FROM q JOIN (SELECT DISTINCT title FROM books_v) b ON {_IN.format('b.title')} GROUP BY 1) t JOIN (SELECT title, min(author) AS author FROM books_v WHERE author IS NOT NULL GROUP BY 1) a USING (title)")
def author_by_title(lib):
    return R.author_of_title(questions(lib), lib.books_v)


_AUTHOR = f"SELECT question_id, min(author) AS author FROM q JOIN (SELECT DISTINCT author FROM books_v WHERE author IS NOT NULL) b ON {_IN.format('b.author')} GROUP BY 1"


@query("books_by_author_match", "books_v", f", q AS ({_QUESTIONS}), f AS ({_AUTHOR}) SELECT question_id, author, id, title, volume, row_number() OVER (PARTITION BY question_id ORDER BY volume NULLS FIRST, title, id) AS position FROM f JOIN books_v USING (author)")
def books_by_author_match(lib):
    return R.books_of_author(questions(lib), lib.books_v).withColumn("position", F.col("position").cast("long"))


@query("volumes_of_title", "books_v", f", q AS ({_QUESTIONS}) SELECT question_id, title, volumes, pages FROM (SELECT question_id, min(title) AS title FROM q JOIN (SELECT DISTINCT title FROM books_v) b ON {_IN.format('b.title')} GROUP BY 1) JOIN (SELECT title, count(*) AS volumes, CAST(sum(total_pages) AS BIGINT) AS pages FROM books_v GROUP BY 1) USING (title)")
def volumes_of_title(lib):
    return R.volumes_of_title(questions(lib), lib.books_v)


_LABELS = "SELECT title, author, volume, id, title || coalesce(' / ' || author, '') || CASE WHEN status <> 'ready' THEN ' [Status: ' || status || ']' ELSE '' END AS label FROM books_v"


@query("catalog_context", "books_v", f""", q AS ({_QUESTIONS}), l AS ({_LABELS}), f AS ({_AUTHOR}),
t AS (SELECT question_id, min(title) AS title FROM q JOIN (SELECT DISTINCT title FROM books_v) b ON {_IN.format('b.title')} GROUP BY 1)
SELECT t.question_id, 'title' AS kind, t.title AS name FROM t
UNION ALL SELECT f.question_id, 'author', f.author FROM f WHERE f.question_id NOT IN (SELECT question_id FROM t)
UNION ALL SELECT q.question_id, 'all', NULL FROM q WHERE q.question_id NOT IN (SELECT question_id FROM t) AND q.question_id NOT IN (SELECT question_id FROM f)""")
def catalog_context(lib):
    return R.catalog_context(questions(lib), lib.books_v)


@query("catalog_lists", "books_v", f""", l AS ({_LABELS})
SELECT 'title' AS kind, title AS name, id, label FROM l UNION ALL SELECT 'author', author, id, label FROM l WHERE author IS NOT NULL UNION ALL SELECT 'all', NULL, id, label FROM l""")
def catalog_lists(lib):
    return R.catalog_lists(lib.books_v).select("kind", "name", "id", "label")


@query("history_last6", "history_v", """
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM (
 SELECT conv_id, turn, (CASE WHEN role = 'user' THEN 'User' ELSE 'AI' END) || ': ' || trim(replace(text, chr(10), ' ')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM history_v) WHERE k <= 6 GROUP BY conv_id""")
def history_last6(lib):
    return R.history_lines(lib.history_v)


ASKED = ("سەن كىمسەن؟", "قانداق ياردەم بېرىسەن؟", "بۇ كىتابنىڭ ئاپتورى كىم؟", "بۇ بەتتە نېمە بار؟", "ئۇشبۇ تومدا بارمۇ؟", "ئۇ قەيەرلىك؟", "تارىخ نېمە؟", "قايسى كىتابلار بار؟")


_AS_ONE = str.maketrans("ېىي", "ییی")
_SAID = lambda phrases, q="m": "(" + " OR ".join(f"contains({q}, '{p.translate(_AS_ONE) if q == 'm' else p}')" for p in phrases) + ")"
_WORDS = ", ".join(f"'{p.translate(_AS_ONE)}'" for p in R.PRONOUNS)
_REFERS = f"(list_has_any(w, [{_WORDS}]) OR len(list_filter(w, lambda x: ends_with(x, '{R.WHAT_ABOUT.translate(_AS_ONE)}'))) > 0)"


@query("route_intent", "", f"""
WITH a AS (SELECT conv_id, turn, [{", ".join(f"'{q}'" for q in ASKED)}][CAST(conv_id % {len(ASKED)} AS INT) + 1] || ' ' || coalesce(text, '') AS q FROM conversations),
m AS (SELECT *, translate(trim(q), 'ېىي', 'ییی') AS m FROM a), w AS (SELECT *, regexp_split_to_array(m, '[ \\t\\n\\r]+') AS w FROM m)
SELECT conv_id, turn, CASE {" ".join(f"WHEN {_SAID(R.PHRASES[n])} THEN '{n}'" for n in ("identity", "capabilities", "author_by_title", "books_by_author", "volume_info"))}
 WHEN turn > 0 AND ({_SAID(R.PHRASES["follow_up"])} OR {_REFERS}) THEN 'follow_up'
 {" ".join(f"WHEN NOT turn % 3 = 2 AND {_SAID(R.PHRASES[n], 'trim(q)')} THEN '{n}'" for n in ("current_page", "current_volume"))} ELSE 'agent_rag' END AS intent,
 {_SAID(R.PHRASES["catalog"])} AND NOT {_SAID(R.CONTENT_SIGNALS)} AS is_catalog FROM w""")
def route_intent(lib):
    ask = F.array(*map(F.lit, ASKED))[(F.col("conv_id") % len(ASKED)).cast("int")]
    rows = lib.conversations.select("conv_id", "turn", F.concat(ask, F.lit(" "), F.coalesce("text", F.lit(""))).alias("question"))
    return rows.select("conv_id", "turn", R.intent(F.col("question"), F.col("turn") > 0, F.col("turn") % 3 == 2).alias("intent"), R.is_catalog_question(F.col("question")).alias("is_catalog"))


@query("summaries_of_books", "summaries_v books_v", "SELECT s.book_id, s.summary, b.title FROM summaries_v s JOIN books_v b ON b.id = s.book_id WHERE s.book_id IN ('src1', 'src2', 'src3', 'src12') AND s.summary IS NOT NULL AND (s.summary ILIKE '%src1%' OR s.summary ILIKE '%two%')")
def summaries_of_books(lib):
    return R.summaries_of(lib.summaries_v, lib.books_v, ["src1", "src2", "src3", "src12"], ["SRC1", "two"]).select("book_id", "summary", "title")


@query("current_page_context", "pages_v books_v", "SELECT p.id, md5('[BookID: ' || b.id || ', Book: ' || b.title || coalesce(', Author: ' || b.author, '') || coalesce(', Volume: ' || b.volume, '') || ', Page: ' || p.page_number || ']' || chr(10) || p.text) AS digest FROM pages_v p JOIN books_v b ON b.id = p.book_id")
def current_page_context(lib):
    from quillspark.functions.text import document_header

    both = lib.pages_v.select(F.col("id").alias("page_id"), "book_id", "page_number", "text").join(lib.books_v, F.col("book_id") == lib.books_v["id"])
    head = document_header(F.col("text"), F.col("book_id"), F.col("title"), F.col("author"), F.col("volume"), F.col("page_number"))
    return both.select(F.col("page_id").alias("id"), F.md5(head).alias("digest"))


@query("nearest_page_of_books", "chunks_v", _Q + f"SELECT book_id, id, similarity FROM (SELECT c.book_id, c.id, round({_SIM.format('c')}, 6) AS similarity, row_number() OVER (PARTITION BY c.book_id ORDER BY {_SIM.format('c')} DESC, c.id) AS k FROM chunks_v c CROSS JOIN q) WHERE k = 1")
def nearest_page_of_books(lib):
    near = lib.chunks_v.withColumn("s", V.cosine(F.col("embedding"), question(lib)))
    nth = F.row_number().over(W.partitionBy("book_id").orderBy(F.col("s").desc(), "id"))
    return near.withColumn("nth", nth).where("nth = 1").select("book_id", "id", F.round("s", 6).alias("similarity"))
