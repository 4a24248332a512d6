"""Pipeline queries: statistics, state changes and the outbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import cascades as D
from quillspark.operators import claims as C
from quillspark.operators import merge as M
from quillspark.operators import metrics as X
from quillspark.operators import pipeline as P
from quillspark.operators import sampling as Sa
from quillspark.plans.registry import query

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
now = lambda: F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


def _done(s: str) -> str:
    return "done" if s == "spell_check" else "succeeded"


_COUNTS = "count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE {s}_milestone = '{_done(s)}') AS {s}, count(*) FILTER (WHERE {s}_milestone IN ('failed', 'error')) AS {s}_failed, count(*) FILTER (WHERE {s}_milestone = 'in_progress') AS {s}_active" for s in P.STEPS
)


@query("book_pipeline_stats", "pages_v", f"SELECT book_id, {_COUNTS} FROM pages_v GROUP BY book_id")
def book_pipeline_stats(lib):
    return P.step_counts(lib.pages_v)


@query("book_pipeline_stats_step", "pages_v", "SELECT book_id, count(*) AS total, count(*) FILTER (WHERE spell_check_milestone = 'done') AS spell_check, count(*) FILTER (WHERE spell_check_milestone IN ('failed', 'error')) AS spell_check_failed, count(*) FILTER (WHERE spell_check_milestone = 'in_progress') AS spell_check_active FROM pages_v GROUP BY book_id")
def book_pipeline_stats_step(lib):
    return P.step_counts(lib.pages_v, ("spell_check",))


_BATCH = "SELECT b.id AS book_id, " + ", ".join(
    f"CAST(CASE WHEN c.total IS NULL AND b.status = 'ready' THEN b.total_pages ELSE coalesce(c.{s}, 0) END AS BIGINT) AS {s}, coalesce(c.{s}_failed, 0) AS {s}_failed, coalesce(c.{s}_active, 0) AS {s}_active" for s in P.STEPS
) + f", {' + '.join(f'coalesce(c.{s}_failed, 0)' for s in P.STEPS)} AS error_count, b.status, b.total_pages FROM books_v b LEFT JOIN (SELECT book_id, {_COUNTS} FROM pages_v GROUP BY book_id) c ON c.book_id = b.id"


@query("batch_stats_defaults", "books_v pages_v", f"SELECT * EXCLUDE (status, total_pages) FROM ({_BATCH})")
def batch_stats_defaults(lib):
    return P.batch_stats(lib.books_v, lib.pages_v)


@query("ready_book_stats", "books_v pages_v", "SELECT book_id, " + ", ".join(
    f"CAST({v} AS BIGINT) AS {s}, CAST(total_pages - {v} - {s}_active - {s}_failed AS BIGINT) AS {s}_pending"
    for s in P.STEPS for v in ([f"CASE WHEN status = 'ready' THEN total_pages ELSE {s} END"] if s != "spell_check" else [s])
) + f" FROM ({_BATCH})")
def ready_book_stats(lib):
    return P.ready_stats(lib.books_v, lib.pages_v)


def _roll(s: str) -> str:
    return f"CASE WHEN total = 0 THEN 'idle' WHEN {s} = total THEN 'complete' WHEN {s}_failed = total THEN 'failed' WHEN {s} + {s}_failed = total THEN 'partial_failure' WHEN {s} > 0 OR {s}_failed > 0 OR {s}_active > 0 THEN 'in_progress' ELSE 'idle' END AS {s}_milestone"


@query("book_milestones", "pages_v", f"SELECT book_id, {', '.join(map(_roll, P.STEPS))} FROM (SELECT book_id, {_COUNTS} FROM pages_v GROUP BY book_id)")
def book_milestones(lib):
    return P.book_milestones(lib.pages_v)


_GONE = "((ocr_milestone IN ('failed', 'error') OR chunking_milestone IN ('failed', 'error') OR embedding_milestone IN ('failed', 'error')) AND retry_count >= 3)"
_TERMINAL = f"SELECT book_id, count(*) AS total, count(*) FILTER (WHERE embedding_milestone = 'succeeded') AS succeeded, count(*) FILTER (WHERE {_GONE}) AS failed_exhausted FROM pages_v GROUP BY book_id HAVING count(*) = count(*) FILTER (WHERE embedding_milestone = 'succeeded' OR {_GONE})"


@query("terminal_books", "pages_v", _TERMINAL)
def terminal_books(lib):
    return P.terminal_books(lib.pages_v)


@query("books_ready_or_error", "books_v pages_v", f"""
SELECT b.id, CASE WHEN t.failed_exhausted = 0 THEN 'ready' ELSE 'error' END AS outcome FROM books_v b JOIN ({_TERMINAL}) t ON t.book_id = b.id
WHERE (t.failed_exhausted = 0 AND (b.pipeline_step IS NULL OR b.pipeline_step <> 'ready')) OR (t.failed_exhausted > 0 AND b.pipeline_step <> 'failed')""")
def books_ready_or_error(lib):
    return P.settled_books(lib.books_v, lib.pages_v)


@query("reset_failed_pages", "pages_v", "SELECT id, retry_count + CAST(CASE WHEN retry_count < 3 AND (" + " OR ".join(f"{s}_milestone IN ('failed', 'error')" for s in P.STEPS[:3]) + ") THEN 1 ELSE 0 END AS INT) AS retry_count, " + ", ".join(f"CASE WHEN retry_count < 3 AND {s}_milestone IN ('failed', 'error') THEN 'idle' ELSE {s}_milestone END AS {s}_milestone" for s in P.STEPS[:3]) + " FROM pages_v")
def reset_failed_pages(lib):
    return P.reset_for_retry(lib.pages_v).select("id", "retry_count", *[f"{s}_milestone" for s in P.STEPS[:3]])


@query("pages_by_status", "pages_v", "SELECT CASE " + " ".join(f"WHEN {s}_milestone NOT IN ('idle', 'succeeded') THEN '{s}:' || {s}_milestone" for s in P.STEPS) + " ELSE 'idle' END AS status, count(*) AS n FROM pages_v WHERE NOT (embedding_milestone = 'succeeded' AND spell_check_milestone = 'done') GROUP BY 1")
def pages_by_status(lib):
    rows = lib.pages_v.where("NOT (embedding_milestone = 'succeeded' AND spell_check_milestone = 'done')")
    return rows.groupBy(P.page_status().alias("status")).agg(F.count("*").alias("n"))


@query("claim_pages", "pages_v", "SELECT id, book_id FROM pages_v WHERE chunking_milestone = 'idle' AND ocr_milestone = 'succeeded' ORDER BY id LIMIT 50")
def claim_pages(lib):
    return P.claimable(lib.pages_v, "chunking", 50)


@query("spell_scan_capped", "pages_v", """
, idle AS (SELECT * FROM pages_v WHERE spell_check_milestone = 'idle' AND embedding_milestone = 'succeeded'),
act AS (SELECT DISTINCT book_id FROM pages_v WHERE spell_check_milestone = 'in_progress'),
fresh AS (SELECT book_id FROM (SELECT DISTINCT book_id FROM idle) WHERE book_id NOT IN (SELECT book_id FROM act) ORDER BY book_id LIMIT greatest(0, 6 - (SELECT count(*) FROM act)))
SELECT id, book_id FROM idle WHERE book_id IN (SELECT book_id FROM act UNION ALL SELECT book_id FROM fresh) ORDER BY id LIMIT 40""".replace("\n, idle", "\n  , idle", 1))
def spell_scan_capped(lib):
    return P.spell_claims(lib.pages_v, 6, 40)


@query("failed_pages_union", "pages_v", "SELECT DISTINCT id FROM (" + " UNION ALL ".join(f"(SELECT id FROM pages_v WHERE {s}_milestone IN ('failed', 'error') AND retry_count < 3 ORDER BY id LIMIT 30)" for s in P.STEPS) + ") ORDER BY id LIMIT 60")
def failed_pages_union(lib):
    return P.failed_pages(lib.pages_v, 30, 60)


@query("remaining_work", "pages_v", "SELECT book_id, count(*) FILTER (WHERE spell_check_milestone IN ('idle', 'in_progress')) AS remaining FROM pages_v GROUP BY book_id")
def remaining_work(lib):
    return P.remaining_work(lib.pages_v, "spell_check")


@query("outbox_dispatch", "events_v", "SELECT id, page_id, event_type, CASE event_type WHEN 'ocr_succeeded' THEN 'chunking_job' WHEN 'chunking_succeeded' THEN 'embedding_job' END AS job FROM events_v WHERE NOT processed")
def outbox_dispatch(lib):
    return P.dispatched(lib.events_v)


@query("outbox_batch", "events_v", "SELECT id, page_id, event_type, CASE event_type WHEN 'ocr_succeeded' THEN 'chunking_job' WHEN 'chunking_succeeded' THEN 'embedding_job' END AS job FROM events_v WHERE NOT processed ORDER BY id LIMIT 100")
def outbox_batch(lib):
    return P.dispatched(lib.events_v, 100)


@query("purge_events", "events_v", f"SELECT count(*) AS n, sum(id) AS ids FROM events_v WHERE NOT (processed AND created_at < {NOW} - INTERVAL 7 DAYS)".replace("sum(id)", "CAST(sum(id) AS BIGINT)"))
def purge_events(lib):
    return P.events_kept(lib.events_v, now()).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("stale_claims", "events_v", f"SELECT id FROM events_v WHERE NOT processed AND created_at < {NOW} - INTERVAL 15 MINUTES")
def stale_claims(lib):
    return P.stale(lib.events_v, ~F.col("processed"), "created_at", now(), 15).select("id")


@query("stale_pages", "pages_v events_v", f"""
SELECT p.book_id, count(DISTINCT p.id) AS n FROM pages_v p JOIN events_v e ON e.page_id = p.id
WHERE p.spell_check_milestone = 'in_progress' AND e.created_at < {NOW} - INTERVAL 30 MINUTES GROUP BY p.book_id""")
def stale_pages(lib):
    seen = lib.pages_v.join(lib.events_v.select(F.col("page_id").alias("id"), "created_at"), "id")
    return P.stale(seen, P.milestone("spell_check") == "in_progress", "created_at", now(), 30).groupBy("book_id").agg(F.countDistinct("id").alias("n"))


@query("reprocess_from_step", "pages_v", "SELECT id, ocr_milestone, 'idle' AS chunking_milestone, 'idle' AS embedding_milestone, 'idle' AS spell_check_milestone, CAST(0 AS INT) AS retry_count FROM pages_v")
def reprocess_from_step(lib):
    return M.reprocessed(lib.pages_v, "chunking").select("id", *[f"{s}_milestone" for s in P.STEPS], "retry_count")


_HIT = "(" + " OR ".join(f"{s}_milestone IN ('failed', 'error')" for s in P.STEPS) + ")"


@query("retry_failed", "pages_v", f"SELECT id, {_HIT} AS was_reset, CAST(CASE WHEN {_HIT} THEN 0 ELSE retry_count END AS INT) AS retry_count, " + ", ".join(f"CASE WHEN {s}_milestone IN ('failed', 'error') THEN 'idle' ELSE {s}_milestone END AS {s}_milestone" for s in P.STEPS) + " FROM pages_v")
def retry_failed(lib):
    return M.retried(lib.pages_v).select("id", "was_reset", "retry_count", *[f"{s}_milestone" for s in P.STEPS])


@query("upsert_pages", "pages_v", """
SELECT coalesce(n.book_id, p.book_id) AS book_id, coalesce(n.page_number, p.page_number) AS page_number, md5(CASE WHEN n.book_id IS NULL THEN p.text ELSE n.text END) AS text_md5, p.retry_count
FROM pages_v p FULL JOIN (SELECT book_id, CAST(page_number + 20 AS INT) AS page_number, 'new ' || text AS text FROM pages_v WHERE id % 7 = 0) n ON n.book_id = p.book_id AND n.page_number = p.page_number""")
def upsert_pages(lib):
    new = lib.pages_v.where("id % 7 = 0").select("book_id", (F.col("page_number") + 20).alias("page_number"), F.concat(F.lit("new "), "text").alias("text"))
    return M.upserted(lib.pages_v.select("book_id", "page_number", "text", "retry_count"), new, ["book_id", "page_number"]).select("book_id", "page_number", F.md5("text").alias("text_md5"), "retry_count")


@query("upsert_chunks", "chunks_v", """
SELECT coalesce(n.book_id, c.book_id) AS book_id, coalesce(n.page_number, c.page_number) AS page_number, coalesce(n.chunk_index, c.chunk_index) AS chunk_index, CAST(coalesce(n.label, c.label) AS INT) AS label
FROM chunks_v c FULL JOIN (SELECT book_id, page_number, CAST(chunk_index + 3 AS INT) AS chunk_index, CAST(-label AS INT) AS label FROM chunks_v) n
ON n.book_id = c.book_id AND n.page_number = c.page_number AND n.chunk_index = c.chunk_index""")
def upsert_chunks(lib):
    keys = ["book_id", "page_number", "chunk_index"]
    new = lib.chunks_v.select("book_id", "page_number", (F.col("chunk_index") + 3).alias("chunk_index"), (-F.col("label")).alias("label"))
    return M.upserted(lib.chunks_v.select(*keys, "label"), new, keys)


@query("rechunk_replace", "chunks_v", """
SELECT book_id, page_number, chunk_index, text, embedding IS NULL AS is_new FROM (
  SELECT book_id, page_number, chunk_index, CAST(id AS VARCHAR) AS text, embedding FROM chunks_v WHERE NOT (book_id < 'src12' AND page_number = 2)
  UNION ALL SELECT book_id, page_number, chunk_index, 'new', NULL FROM chunks_v WHERE book_id < 'src12' AND page_number = 2 AND chunk_index < 3)""")
def rechunk_replace(lib):
    chunks = lib.chunks_v.select("book_id", "page_number", "chunk_index", F.col("id").cast("string").alias("text"), "embedding")
    new = chunks.where("book_id < 'src12' AND page_number = 2 AND chunk_index < 3").withColumn("text", F.lit("new"))
    return M.rechunked(chunks, new).select("book_id", "page_number", "chunk_index", "text", F.col("embedding").isNull().alias("is_new"))


@query("patch_pages", "pages_v", """
SELECT p.id, md5(coalesce(n.text, p.text)) AS text_md5, CASE WHEN n.text IS NOT NULL AND n.text IS DISTINCT FROM p.text THEN 'idle' ELSE p.chunking_milestone END AS chunking_milestone
FROM pages_v p LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN text WHEN id % 3 = 0 THEN NULL ELSE lower(text) END AS text FROM pages_v WHERE id % 5 = 0) n ON n.id = p.id""")
def patch_pages(lib):
    new = F.when(F.col("id") % 2 == 0, F.col("text")).when(F.col("id") % 3 == 0, None).otherwise(F.lower("text"))
    patch = lib.pages_v.where("id % 5 = 0").select("id", new.alias("text"), F.lit(None).cast("string").alias("status"))
    return M.patched(lib.pages_v, patch).select("id", F.md5("text").alias("text_md5"), "chunking_milestone")


@query("delete_book", "books_v pages_v chunks_v", "SELECT 'books' AS name, count(*) AS n FROM books_v WHERE id <> 'src3' UNION ALL SELECT 'pages', count(*) FROM pages_v WHERE book_id <> 'src3' UNION ALL SELECT 'chunks', count(*) FROM chunks_v WHERE book_id <> 'src3'")
def delete_book(lib):
    left = M.without_book("src3", books=lib.books_v, pages=lib.pages_v, chunks=lib.chunks_v)
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("embedding_cut_over", "summaries_v", "SELECT book_id, coalesce(CASE WHEN book_id < 'src12' THEN 'draft of ' || book_id END, summary) AS summary FROM summaries_v")
def embedding_cut_over(lib):
    draft = F.when(F.col("book_id") < "src12", F.concat(F.lit("draft of "), "book_id"))
    return M.cut_over(lib.summaries_v.select("book_id", "summary", draft.alias("draft")), "summary", "draft")


@query("read_counts", "books_v events_v", "SELECT b.id, b.total_pages + coalesce(e.n, 0) AS read_count FROM books_v b LEFT JOIN (SELECT 'src' || (page_id % 25) AS id, count(*) AS n FROM events_v GROUP BY 1) e ON e.id = b.id")
def read_counts(lib):
    events = lib.events_v.select(F.concat(F.lit("src"), F.col("page_id") % 25).alias("book_id"))
    return M.counted_up(lib.books_v.select("id", F.col("total_pages").cast("long").alias("read_count")), events, "id", "book_id", "read_count")


@query("usage_added", "usage_v", "SELECT user_id, usage_date, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM usage_v UNION ALL SELECT * FROM usage_v WHERE user_id % 2 = 0) GROUP BY 1, 2")
def usage_added(lib):
    return M.usage_added(lib.usage_v, lib.events.where("user_id % 2 = 0").select("user_id", "ts"))


@query("dictionary_word_added", "events_v", "SELECT id, CASE WHEN word IN ('alpha', 'beta') AND status = 'open' THEN 'ignored' ELSE status END AS status FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS word, CASE WHEN processed THEN 'corrected' ELSE 'open' END AS status FROM events_v)")
def dictionary_word_added(lib):
    word = F.when(F.col("id") % 3 == 0, "alpha").when(F.col("id") % 3 == 1, "beta").otherwise("gamma")
    issues = lib.events_v.select("id", word.alias("word"), F.when(F.col("processed"), "corrected").otherwise("open").alias("status"))
    words = lib.spark.range(2).select(F.when(F.col("id") == 0, "alpha").otherwise("beta").alias("word"))
    return M.word_added(lib.dictionary_v, issues, words)[1].select("id", "status")


@query("ignore_issues", "events_v", "SELECT id, CASE WHEN page_id = (SELECT min(page_id) FROM events_v) AND id IN (1, 2, 3) THEN 'ignored' ELSE 'open' END AS status FROM events_v WHERE page_id IS NOT NULL")
def ignore_issues(lib):
    first = lib.events_v.agg(F.min("page_id")).first()[0]
    return M.issues_ignored(lib.events_v.select("id", "page_id", F.lit("open").alias("status")), first, [1, 2, 3]).select("id", "status")


@query("purge_tokens", "tokens_v", "SELECT jti FROM tokens_v WHERE NOT (revoked OR expires_at < TIMESTAMP '1997-01-01 00:00:00')")
def purge_tokens(lib):
    return M.tokens_purged(lib.tokens_v, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("jti")


@query("valid_tokens", "tokens_v", "SELECT jti, token_hash FROM tokens_v WHERE NOT revoked AND expires_at > TIMESTAMP '1997-01-01 00:00:00'")
def valid_tokens(lib):
    return M.tokens_valid(lib.tokens_v, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("jti", "token_hash")


@query("rag_eval_summary", "rag_eval_v", f"SELECT count(*) AS n, {', '.join(f'round(coalesce(avg({c}), 0), 6) AS avg_{c}' for c in ('latency_ms', 'retrieved_count', 'context_chars', 'answer_chars'))} FROM rag_eval_v WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def rag_eval_summary(lib):
    return X.evaluation_summary(lib.rag_eval_v, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


@query("rag_avg_latency", "rag_eval_v", "SELECT book_id, round(avg(latency_ms), 6) AS latency_ms FROM rag_eval_v GROUP BY book_id")
def rag_avg_latency(lib):
    return X.average_latency(lib.rag_eval_v)


@query("rag_recent", "rag_eval_v", "SELECT id, latency_ms FROM rag_eval_v ORDER BY ts DESC, id LIMIT 20")
def rag_recent(lib):
    return X.recent(lib.rag_eval_v, "ts", 20).select("id", "latency_ms")


@query("system_totals", "books_v pages_v chunks_v", """
SELECT *, CASE WHEN pages > 0 THEN round(100.0::DOUBLE * indexed / pages, 2) ELSE 0 END AS indexed_pct, CASE WHEN chunks > 0 THEN round(100.0::DOUBLE * embedded / chunks, 2) ELSE 0 END AS embedded_pct FROM
 (SELECT count(*) AS books FROM books_v), (SELECT count(*) AS pages, count(*) FILTER (WHERE embedding_milestone = 'succeeded') AS indexed, count(*) FILTER (WHERE """ + _HIT + """) AS failed FROM pages_v),
 (SELECT count(*) AS chunks, count(embedding) AS embedded FROM chunks_v)""")
def system_totals(lib):
    return X.system_totals(lib.books_v, lib.pages_v, lib.chunks_v)


@query("minutes_to_ready", "", "SELECT o_orderkey AS id, round(epoch(l.d - o_orderdate) / 60.0::DOUBLE, 4) AS minutes FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l.d >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 7 DAYS ORDER BY l.d DESC, id LIMIT 10")
def minutes_to_ready(lib):
    shipped = lib.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_updated"))
    books = lib.orders.join(shipped, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("upload_date"), "last_updated", F.when(F.col("o_orderstatus") == "O", "ready").otherwise("error").alias("status"))
    return X.minutes_to_ready(books, F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"))


@query("rate_limit_windows", "", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, greatest(count(*) - 15, 0) AS refused FROM events GROUP BY 1")
def rate_limit_windows(lib):
    return X.rate_limited(lib.events, "1 hour", 15)


@query("daily_quota", "usage_v users_v", """
SELECT u.user_id, u.usage_date, u.cnt, CAST(CASE s.role WHEN 'admin' THEN NULL WHEN 'editor' THEN 100 WHEN 'reader' THEN 20 ELSE 10 END AS INT) AS most,
 CASE s.role WHEN 'admin' THEN true WHEN 'editor' THEN u.cnt < 100 WHEN 'reader' THEN u.cnt < 20 ELSE u.cnt < 10 END AS allowed FROM usage_v u JOIN users_v s ON s.id = u.user_id""")
def daily_quota(lib):
    return X.daily_quota(lib.usage_v, lib.users_v)


@query("breaker_states", "", """
WITH RECURSIVE c AS (SELECT user_id % 10 AS key, floor(epoch(ts))::DOUBLE AS at, value > 60 AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
s AS (
 SELECT DISTINCT key, 0::BIGINT AS k, 'closed' AS state, 0 AS failures, 0.0::DOUBLE AS since, 0 AS n_refused FROM c
 UNION ALL
 SELECT s.key, c.k, CASE WHEN s.state = 'open' AND c.at < s.since + 3600 THEN 'open' WHEN c.ok THEN 'closed' WHEN s.state <> 'closed' OR s.failures + 1 >= 5 THEN 'open' ELSE 'closed' END,
  CASE WHEN s.state = 'open' AND c.at < s.since + 3600 THEN s.failures WHEN c.ok THEN 0 ELSE s.failures + 1 END,
  CASE WHEN s.state = 'open' AND c.at < s.since + 3600 OR c.ok OR NOT (s.state <> 'closed' OR s.failures + 1 >= 5) THEN s.since ELSE c.at END,
  CASE WHEN s.state = 'open' AND c.at < s.since + 3600 THEN s.n_refused + 1 ELSE s.n_refused END
 FROM s JOIN c ON c.key = s.key AND c.k = s.k + 1)
SELECT key, arg_max(state, k) AS state, arg_max(failures, k) AS failures, arg_max(n_refused, k) AS n_refused FROM s GROUP BY key""")
def breaker_states(lib):
    calls = lib.events.select((F.col("user_id") % 10).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("id"), (F.col("value") > 60).alias("ok"))
    return X.breaker_states(calls, cooling=3600)


@query("pages_claimed", "pages_v", """
SELECT id, CASE WHEN id IN (SELECT id FROM pages_v WHERE chunking_milestone = 'idle' AND ocr_milestone = 'succeeded' ORDER BY id LIMIT 50) THEN 'in_progress' ELSE chunking_milestone END AS chunking_milestone FROM pages_v""")
def pages_claimed(lib):
    return C.pages_claimed(lib.pages_v, "chunking", 50, now()).select("id", "chunking_milestone")


@query("spell_pages_claimed", "pages_v", """
, a AS (SELECT DISTINCT book_id FROM pages_v WHERE spell_check_milestone = 'in_progress'), i AS (SELECT id, book_id FROM pages_v WHERE spell_check_milestone = 'idle' AND embedding_milestone = 'succeeded'),
f AS (SELECT book_id, row_number() OVER (ORDER BY book_id) AS nth FROM (SELECT DISTINCT book_id FROM i WHERE book_id NOT IN (SELECT book_id FROM a))),
c AS (SELECT id FROM i WHERE book_id IN (SELECT book_id FROM a UNION ALL SELECT book_id FROM f WHERE nth <= greatest(0, 18 - (SELECT count(*) FROM a))) ORDER BY id LIMIT 40)
SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'in_progress' ELSE spell_check_milestone END AS spell_check_milestone FROM pages_v""")
def spell_pages_claimed(lib):
    return C.spell_pages_claimed(lib.pages_v, 18, 40, now()).select("id", "spell_check_milestone")


def _seen(lib):
    """Pages with the time of their last event."""
    last = lib.events_v.groupBy(F.col("page_id").alias("id")).agg(F.max("created_at").alias("last_updated"))
    return lib.pages_v.join(last, "id", "left")


_SEEN = ", s AS (SELECT p.*, e.last_updated FROM pages_v p LEFT JOIN (SELECT page_id, max(created_at) AS last_updated FROM events_v GROUP BY 1) e ON e.page_id = p.id)"
_IDLE = ", ".join(f"CASE WHEN last_updated < {NOW} - INTERVAL 30 MINUTES AND {s}_milestone = 'in_progress' THEN 'idle' ELSE {s}_milestone END AS {s}_milestone" for s in P.STEPS)
_STUCK = f"last_updated < {NOW} - INTERVAL 30 MINUTES AND ({' OR '.join(f"{s}_milestone = 'in_progress'" for s in P.STEPS)})"


@query("pages_released", "pages_v events_v", f"{_SEEN} SELECT id, retry_count, {_IDLE} FROM s")
def pages_released(lib):
    return C.pages_released(_seen(lib), _milestoned(lib), now())[0].select("id", "retry_count", *[f"{s}_milestone" for s in P.STEPS])


@query("books_rolled_up_again", "books_v pages_v events_v", f"""{_SEEN}, a AS (SELECT book_id, {_IDLE} FROM s), t AS (SELECT DISTINCT book_id FROM s WHERE {_STUCK})
SELECT b.id, {", ".join(f"coalesce(m.{s}_milestone, 'idle') AS {s}_milestone" for s in P.STEPS)} FROM books_v b LEFT JOIN (SELECT book_id, {", ".join(map(_roll, P.STEPS))} FROM (SELECT book_id, {_COUNTS} FROM a WHERE book_id IN (SELECT book_id FROM t) GROUP BY book_id)) m ON m.book_id = b.id""")
def books_rolled_up_again(lib):
    return C.pages_released(_seen(lib), _milestoned(lib), now())[1].select("id", *[f"{s}_milestone" for s in P.STEPS])


def _milestoned(lib):
    return lib.books_v.withColumns({f"{s}_milestone": F.lit("idle") for s in P.STEPS})


_STEPPED = "s AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE 'chunking' END AS pipeline_step FROM pages_v)"
_FAILS = " OR ".join(f"{s}_milestone IN ('failed', 'error')" for s in P.STEPS)
_DRIVEN = f""", {_STEPPED},
f AS (SELECT p.id FROM s p JOIN books_v b ON b.id = p.book_id WHERE p.ocr_milestone = 'idle' AND b.status <> 'ready' ORDER BY p.id LIMIT 60),
n AS (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM f) THEN 0 ELSE retry_count END AS retry_count, CASE WHEN id IN (SELECT id FROM f) THEN coalesce(pipeline_step, 'ocr') ELSE pipeline_step END AS pipeline_step) FROM s),
r AS (SELECT id FROM n WHERE retry_count < 3 AND ({_FAILS}) ORDER BY id LIMIT 60),
d AS (SELECT * REPLACE ({", ".join(f"CASE WHEN id IN (SELECT id FROM r) AND {s}_milestone IN ('failed', 'error') THEN 'idle' ELSE {s}_milestone END AS {s}_milestone" for s in P.STEPS)}) FROM n),
x AS (SELECT book_id, count(*) AS total, count(*) FILTER (WHERE embedding_milestone = 'succeeded' OR bad) AS terminal, count(*) FILTER (WHERE bad) AS failed FROM
 (SELECT *, retry_count >= 3 AND ({" OR ".join(f"{s}_milestone IN ('failed', 'error')" for s in P.STEPS[:3])}) AS bad FROM d) GROUP BY book_id),
o AS (SELECT b.id, CASE WHEN x.failed = 0 THEN 'ready' ELSE 'error' END AS outcome FROM books_v b JOIN x ON x.book_id = b.id WHERE total = terminal
 AND ((failed = 0 AND b.pipeline_step IS DISTINCT FROM 'ready') OR (failed > 0 AND b.pipeline_step <> 'failed')))"""


def _driven(lib):
    stepped = lib.pages_v.withColumn("pipeline_step", F.when(F.col("id") % 4 != 0, "chunking"))
    return C.driven(stepped, lib.books_v, lib.summaries_v, 60)


@query("driven_pages", "pages_v books_v", f"{_DRIVEN} SELECT id, retry_count, pipeline_step, {', '.join(f'{s}_milestone' for s in P.STEPS)} FROM d")
def driven_pages(lib):
    return _driven(lib)[0].select("id", "retry_count", "pipeline_step", *[f"{s}_milestone" for s in P.STEPS])


@query("driven_books", "pages_v books_v", f"{_DRIVEN} SELECT b.id, CASE o.outcome WHEN 'ready' THEN 'ready' WHEN 'error' THEN 'failed' ELSE b.pipeline_step END AS pipeline_step, coalesce(o.outcome, b.status) AS status FROM books_v b LEFT JOIN o ON o.id = b.id")
def driven_books(lib):
    return _driven(lib)[1].select("id", "pipeline_step", "status")


@query("driven_jobs", "pages_v books_v summaries_v", f"{_DRIVEN} SELECT 'summary_job' AS job, id AS book_id, 'summary:' || id AS job_id FROM o WHERE outcome = 'ready' AND id NOT IN (SELECT book_id FROM summaries_v)")
def driven_jobs(lib):
    return _driven(lib)[2]


_GONE = "n % 4 = 1"


@query("cascade_deleted", "books_v pages_v chunks_v events_v rag_eval_v", f"""
, b AS (SELECT id FROM books_v WHERE {_GONE}), p AS (SELECT id FROM pages_v WHERE book_id IN (SELECT id FROM b))
SELECT 'books' AS name, id AS row, CAST(NULL AS VARCHAR) AS of FROM books_v WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'pages', CAST(id AS VARCHAR), book_id FROM pages_v WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'chunks', CAST(id AS VARCHAR), book_id FROM chunks_v WHERE book_id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'events', CAST(id AS VARCHAR), CAST(page_id AS VARCHAR) FROM events_v WHERE page_id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'evaluations', CAST(id AS VARCHAR), CASE WHEN book_id NOT IN (SELECT id FROM b) THEN book_id END FROM rag_eval_v""")
def cascade_deleted(lib):
    tables = {"books": lib.books_v, "pages": lib.pages_v.drop("text"), "chunks": lib.chunks_v.drop("embedding"), "events": lib.events_v, "evaluations": lib.rag_eval_v}
    keys = (*D.LIBRARY_KEYS, D.Key("evaluations", "book_id", "books", then="set null"))
    left = D.without(tables, {"books": lib.books_v.where(_GONE).select("id")}, keys)
    of = {"books": F.lit(None), "events": F.col("page_id")}
    parts = [t.select(F.lit(name).alias("name"), F.col("id").cast("string").alias("row"), of.get(name, F.col("book_id")).cast("string").alias("of")) for name, t in left.items()]
    return reduce(DataFrame.unionByName, parts)


@query("tokens_presented", "tokens_v", "SELECT jti, user_id FROM tokens_v WHERE NOT revoked AND expires_at > TIMESTAMP '1997-01-01 00:00:00' AND jti % 3 <> 0")
def tokens_presented(lib):
    asked = lib.orders.select(F.col("o_orderkey").alias("jti"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).otherwise(F.lit(-1)).alias("token"))
    return D.tokens_presented(lib.tokens_v, asked, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("jti", "user_id")


@query("tokens_revoked", "tokens_v", "SELECT jti, revoked OR jti % 7 = 0 OR user_id % 5 = 0 AS revoked FROM tokens_v")
def tokens_revoked(lib):
    out = D.tokens_revoked(lib.tokens_v, lib.tokens_v.where("jti % 7 = 0").select("jti"), lib.tokens_v.where("user_id % 5 = 0").select("user_id"))
    return out.select("jti", "revoked")


_DRAWN = "-ln((CAST('0x' || substr(md5('{0}:' || {1}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


@query("random_proverbs", "proverbs_v", f"SELECT id, text FROM proverbs_v ORDER BY {_DRAWN.format(11, 'id')}, id LIMIT 5")
def random_proverbs(lib):
    return Sa.bottom_k(lib.proverbs_v, 5, 11).select("id", "text")


@query("pages_drawn_by_length", "pages_v", f"SELECT book_id, id FROM (SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY {_DRAWN.format(7, 'id')} / length(text), id) AS nth FROM pages_v WHERE length(text) > 0) WHERE nth <= 3")
def pages_drawn_by_length(lib):
    rows = lib.texts_v.select("book_id", "id", F.length("text").alias("n"))
    return Sa.bottom_k_by(rows, "book_id", 3, 7, weight="n").select("book_id", "id")
