"""Queries of single-row writes, identities and small helpers, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import catalog as C
from quillspark.operators import merge as M
from quillspark.operators import metrics as X
from quillspark.operators import retrieval as R
from quillspark.operators import vectors as V
from quillspark.plans.registry import query

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_now = lambda: F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("users_inserted", "users_v", "SELECT id, email, role FROM users_v UNION ALL SELECT id + 1000000, 'new-' || email, NULL FROM users_v WHERE role = 'admin'")
def users_inserted(lib):
    new = lib.users_v.where("role = 'admin'").select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("new-"), "email").alias("email"))
    return M.inserted(lib.users_v, new).select("id", "email", "role")


@query("users_updated", "users_v", f"SELECT id, CASE WHEN role = 'reader' THEN 'editor' ELSE role END AS role, CASE WHEN role = 'reader' THEN {_NOW} END AS updated_at FROM users_v")
def users_updated(lib):
    """An update and its time, as a trigger would write it."""
    before = lib.users_v.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    reader = F.col("role") == "reader"
    return M.touched(before.where(reader), _now()).withColumn("role", F.lit("editor")).unionByName(before.where(~reader)).select("id", "role", "updated_at")


@query("users_deleted", "users_v", "SELECT id FROM users_v WHERE NOT (role = 'reader' AND NOT is_active)")
def users_deleted(lib):
    return M.deleted(lib.users_v, (F.col("role") == "reader") & ~F.col("is_active")).select("id")


@query("summaries_upserted", "summaries_v books_v", f"""
SELECT coalesce(b.id, s.book_id) AS book_id, CASE WHEN b.id IS NOT NULL THEN 'About ' || b.title ELSE s.summary END AS summary, CASE WHEN b.id IS NOT NULL THEN {_NOW} END AS generated_at
FROM summaries_v s FULL JOIN (SELECT * FROM books_v WHERE n % 2 = 0) b ON b.id = s.book_id""")
def summaries_upserted(lib):
    before = lib.summaries_v.drop("embedding").withColumn("generated_at", F.lit(None).cast("timestamp_ntz"))
    new = lib.books_v.where("n % 2 = 0").select(F.col("id").alias("book_id"), F.concat(F.lit("About "), "title").alias("summary"), _now().alias("generated_at"))
    return M.upserted(before, new, ["book_id"]).select("book_id", "summary", "generated_at")


@query("settings_read", "users_v", "SELECT role AS key, coalesce(CAST(max(id) AS VARCHAR), 'none') AS value FROM users_v GROUP BY role UNION ALL SELECT 'unheard of', 'none'")
def settings_read(lib):
    settings = lib.users_v.groupBy(F.col("role").alias("key")).agg(F.max("id").cast("string").alias("value"))
    each = [M.config_value(settings, k, "none").select(F.lit(k).alias("key"), "value") for k in ("admin", "editor", "reader", "unheard of")]
    return reduce(DataFrame.unionByName, each)


@query("rows_exist", "books_v users_v", "SELECT 'book' AS what, count(*) > 0 AS found FROM books_v WHERE id = 'src7' UNION ALL SELECT 'none', count(*) > 0 FROM books_v WHERE id = 'src7' AND status = 'nothing' UNION ALL SELECT 'user', count(*) > 0 FROM users_v WHERE role = 'admin' AND is_active")
def rows_exist(lib):
    asked = {"book": C.exists(lib.books_v, id="src7"), "none": C.exists(lib.books_v, id="src7", status="nothing"), "user": C.exists(lib.users_v, role="admin", is_active=True)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("what"), "found") for k, df in asked.items()])


@query("hit_rates", "rag_eval_v", "SELECT book_id, round(CASE WHEN h + m > 0 THEN h / (h + m) ELSE 0 END, 9) AS rate FROM (SELECT book_id, count(*) FILTER (WHERE retrieved_count = 0) AS h, count(*) FILTER (WHERE retrieved_count = 1) AS m FROM rag_eval_v GROUP BY 1)")
def hit_rates(lib):
    of = lib.rag_eval_v.groupBy("book_id").agg(F.count_if(F.col("retrieved_count") == 0).alias("h"), F.count_if(F.col("retrieved_count") == 1).alias("m"))
    return of.select("book_id", F.round(X.hit_rate(F.col("h"), F.col("m")), 9).alias("rate"))


@query("identities", "pages_v users_v", """
SELECT 'token' AS kind, CAST(id AS VARCHAR) AS id, sha256(email) AS digest FROM users_v
UNION ALL SELECT 'address', CAST(id AS VARCHAR), substr(sha256('pepper' || email), 1, 16) FROM users_v
UNION ALL SELECT 'content', CAST(id AS VARCHAR), substr(sha256(text), 1, 12) FROM pages_v""")
def identities(lib):
    of = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), c.alias("digest"))
    users = lib.users_v
    return of("token", users, T.token_digest(F.col("email"))).unionAll(of("address", users, T.address_digest(F.col("email"), "pepper"))).unionAll(of("content", lib.texts_v, T.short_id(F.col("text"))))


@query("dictionary_listed", "dictionary_v", "SELECT id, word FROM (SELECT row_number() OVER (ORDER BY word) AS id, word FROM dictionary_v) ORDER BY id DESC LIMIT 25 OFFSET 25")
def dictionary_listed(lib):
    from pyspark.sql import Window as W

    words = lib.dictionary_v.withColumn("id", F.row_number().over(W.orderBy("word")).cast("long"))  # the view has no ids of its own
    return C.dictionary_page(words, 2, 25).select("id", "word")


@query("shaped_results", "books_v", "SELECT id, coalesce(CASE WHEN n % 4 = 0 THEN NULL ELSE title END, 'Unknown') AS title, CASE WHEN n % 3 = 0 THEN NULL ELSE author END AS author FROM books_v")
def shaped_results(lib):
    odd = lib.books_v.withColumns({"title": F.when(F.col("n") % 4 != 0, F.col("title")), "author": F.when(F.col("n") % 3 == 0, "").otherwise(F.col("author"))})
    return V.shaped(odd).select("id", "title", "author")


@query("history_categories", "books_v", "SELECT id, array_to_string(CASE WHEN cat2 = 'history' THEN [cat1, cat2, 'poetry', 'annals'] ELSE [cat1, cat2] END, ',') AS categories FROM books_v")
def history_categories(lib):
    found = R.with_history_categories(F.array("cat1", "cat2"), "history", ("poetry", "annals"))
    return lib.books_v.select("id", F.array_join(found, ",").alias("categories"))


_CITED = """'See [page (BookID: ' || source || ')](ref:' || source || ':' || (doc_id % 9) || ',' || (doc_id % 7) || ',x) and [sum](ref:' || source || ':summary), [out](https://x.org/a), [in](see [src](ref:b_' || (doc_id % 5) || ':3,4)) ' || left(translate(text, '[]()', ''), 40)"""


@query("citation_links", "", f"""
WITH c AS (SELECT doc_id AS id, source, {_CITED} AS t FROM documents)
SELECT id, 0 AS nth, 'page' AS label, source AS book_id, (id % 9) || ',' || (id % 7) AS pages, false AS is_summary FROM c WHERE t IS NOT NULL
UNION ALL SELECT id, 1, 'sum', source, '', true FROM c WHERE t IS NOT NULL
UNION ALL SELECT id, 2, 'in', 'b_' || (id % 5), '3,4', false FROM c WHERE t IS NOT NULL""")
def citation_links(lib):
    lead = F.concat(F.lit("See [page (BookID: "), "source", F.lit(")](ref:"), "source", F.lit(":"), F.col("doc_id") % 9, F.lit(","), F.col("doc_id") % 7, F.lit(",x) and [sum](ref:"), "source")
    text = F.concat(lead, F.lit(":summary), [out](https://x.org/a), [in](see [src](ref:b_"), F.col("doc_id") % 5, F.lit(":3,4)) "), F.substring(F.translate("text", "[]()", ""), 1, 40))
    links = lib.documents.select(F.col("doc_id").alias("id"), F.posexplode(T.citation_links(text)).alias("nth", "l"))
    return links.select("id", "nth", "l.label", "l.book_id", F.array_join("l.pages", ",").alias("pages"), "l.is_summary")
