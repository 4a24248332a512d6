"""The library's tables: raw Parquet tables and the views that give them the library's shape."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views in SQL that Spark and other engines read alike.
VIEWS = {
    "books_v": """
  SELECT source AS id, md5(source) AS content_hash, concat('Work ', CAST(n % 5 AS VARCHAR(10))) AS title,
         CASE WHEN n % 5 = 4 THEN NULL ELSE concat('Author ', CAST((n % 5) % 3 AS VARCHAR(10))) END AS author,
         CASE WHEN n < 5 THEN NULL ELSE CAST((n - n % 5) / 5 AS INT) END AS volume, CAST(total_pages AS INT) AS total_pages,
         CASE WHEN n % 9 = 0 THEN 'error' WHEN n % 4 = 1 THEN 'pending' ELSE 'ready' END AS status,
         CASE WHEN n % 5 = 0 THEN 'private' WHEN n % 8 = 3 THEN NULL ELSE 'public' END AS visibility,
         CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 'ready' ELSE 'ocr' END AS pipeline_step,
         CASE WHEN n % 2 = 0 THEN ' "history" ' ELSE 'novel' END AS cat1,
         CASE WHEN n % 3 = 0 THEN 'poetry' ELSE 'history' END AS cat2, n AS n
  FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n, count(*) AS total_pages FROM documents GROUP BY source) s""",
    "pages_v": """
  SELECT doc_id AS id, book_id, page_number, text, lang,
         CASE WHEN n % 5 = 0 THEN 'succeeded' WHEN n % 5 = 1 THEN 'failed'
              WHEN n % 5 = 2 THEN CASE WHEN page_number % 2 = 0 THEN 'error' ELSE 'succeeded' END
              WHEN n % 5 = 3 THEN CASE WHEN page_number % 3 = 0 THEN 'in_progress' ELSE 'succeeded' END
              ELSE 'idle' END AS ocr_milestone,
         CASE WHEN n % 5 = 0 OR (n % 5 = 2 AND page_number % 2 = 1) THEN
                   CASE WHEN n % 2 = 1 AND page_number % 7 = 0 THEN 'failed' ELSE 'succeeded' END
              ELSE 'idle' END AS chunking_milestone,
         CASE WHEN n % 5 = 0 OR (n % 5 = 2 AND page_number % 2 = 1) THEN
                   CASE WHEN n % 2 = 1 AND page_number % 7 = 0 THEN 'idle' ELSE 'succeeded' END
              ELSE 'idle' END AS embedding_milestone,
         CASE WHEN page_number % 5 = 0 THEN 'idle' WHEN page_number % 7 = 0 THEN 'in_progress'
              WHEN page_number % 9 = 0 THEN 'failed' ELSE 'done' END AS spell_check_milestone,
         CAST(CASE WHEN n % 5 IN (1, 2) THEN 3 ELSE page_number % 5 END AS INT) AS retry_count,
         (doc_id % 31 = 0) AS is_toc
  FROM (SELECT doc_id, source AS book_id, text, lang, CAST(substr(source, 4) AS INT) AS n,
               CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_number
        FROM documents) d""",
    "chunks_v": """
  SELECT vec_id AS id, concat('src', CAST(vec_id % 20 AS VARCHAR(10))) AS book_id,
         CAST(1 + (vec_id % 100 - vec_id % 20) / 20 AS INT) AS page_number,
         CAST((vec_id - vec_id % 100) / 100 AS INT) AS chunk_index, embedding, label
  FROM embeddings""",
    "events_v": """
  SELECT event_id AS id, user_id AS page_id,
         CASE event_type WHEN 'view' THEN 'ocr_succeeded' WHEN 'click' THEN 'chunking_succeeded'
              WHEN 'purchase' THEN 'embedding_succeeded' WHEN 'error' THEN 'ocr_failed' ELSE 'spell_check_succeeded' END AS event_type,
         props AS payload, (event_id % 3 = 0) AS processed, ts AS created_at, value
  FROM events""",
    "summaries_v": """
  SELECT concat('src', CAST(vec_id AS VARCHAR(10))) AS book_id,
         CASE WHEN vec_id % 5 = 3 THEN NULL ELSE concat('Summary of src', CAST(vec_id AS VARCHAR(10))) END AS summary, embedding
  FROM embeddings WHERE vec_id % 20 < 15""",
    "users_v": """
  SELECT c_custkey AS id, lower(concat(c_name, '@example.org')) AS email, c_name AS display_name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'FURNITURE' THEN 'editor' ELSE 'reader' END AS role,
         (c_custkey % 4 <> 0) AS is_active
  FROM customer""",
    "tokens_v": """
  SELECT o_orderkey AS jti, o_custkey AS user_id, o_orderdate AS expires_at,
         md5(CAST(o_orderkey AS VARCHAR(20))) AS token_hash, (o_orderstatus = 'P') AS revoked
  FROM orders""",
    "contact_v": """
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'reviewed' ELSE 'archived' END AS status,
         o_orderdate AS created_at FROM orders""",
    "rag_eval_v": """
  SELECT event_id AS id, concat('src', CAST(user_id % 20 AS VARCHAR(10))) AS book_id, CAST(floor(value * 10) AS INT) AS latency_ms,
         CAST(event_id % 17 AS INT) AS retrieved_count, CAST(event_id % 4001 AS INT) AS context_chars,
         CAST(event_id % 907 AS INT) AS answer_chars, ts
  FROM events""",
    "usage_v": "SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS cnt FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "history_v": "SELECT conv_id, turn, role, text FROM conversations",
    "proverbs_v": "SELECT item_id AS id, text FROM benchmark",
    "rules_v": """
  SELECT w AS misspelled_word, min(c) AS corrected_word, (length(w) % 2 = 0) AS is_active
  FROM (SELECT translate(lower(split_part(text, ' ', 2)), '.,', '') AS w, translate(lower(split_part(text, ' ', 3)), '.,', '') AS c FROM benchmark) r
  WHERE length(w) >= 2 GROUP BY w""",
}

_NUMBERING = "CAST(row_number() OVER (PARTITION BY source"

#: Words of at least four letters, in SQL for the check engine: those of ``benchmark``, and one row for each on a page.
CHECK_VIEWS = {
    "dictionary_v": "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark) t",
    "words_v": "SELECT id AS page_id, book_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM pages_v",
}
_NEEDS = {"words_v": ["pages_v"]}


#: Ids whose rows are numbered together.
NUMBERED = 100_000


def page_numbers(documents: DataFrame, numbered: int = NUMBERED) -> DataFrame:
    """(doc_id, page_number): places of documents in their sources by doc_id, from 1. Ids are distinct.

    Only ids and sources move: ids that fall into one stretch are numbered together, and what the stretches before have of
    a source is added, so neither a text nor a whole source is in one task.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    thin = documents.select("doc_id", "source", F.floor(F.col("doc_id") / numbered).alias("stretch"))
    upto = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = thin.groupBy("source", "stretch").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("source", "stretch").orderBy("doc_id"))
    placed = thin.withColumn("nth", nth).join(before, F.col("source").eqNullSafe(F.col("s")) & F.col("stretch").eqNullSafe(F.col("t")))
    return placed.select("doc_id", (F.col("before") + F.col("nth")).cast("int").alias("page_number"))


class Library:
    """Tables and views of one data folder, as DataFrames; ``lib.books_v`` or ``lib.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            for raw in RAW:
                if raw in VIEWS[name]:
                    getattr(self, raw).createOrReplaceTempView(raw)
            sql = VIEWS[name]
            if name == "pages_v":  # the same rows, but no text goes through the numbering
                page_numbers(self.documents).createOrReplaceTempView("page_numbers")
                sql = sql[: sql.index(_NUMBERING)] + "k.page_number FROM documents LEFT JOIN page_numbers k USING (doc_id)) d"
            df = self.spark.sql(sql)
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def texts_v(self) -> DataFrame:
        """(id, book_id, text, lang): pages without what their numbers decide."""
        return self.documents.selectExpr("doc_id AS id", "source AS book_id", "text", "lang")

    @cached_property
    def dictionary_v(self) -> DataFrame:
        """(word): distinct words of at least four letters of the proverbs."""
        return words_of(self.benchmark, "text").select("word").distinct()

    @cached_property
    def words_v(self) -> DataFrame:
        """(page_id, book_id, word): every such word of every page."""
        return words_of(self.texts_v.withColumnRenamed("id", "page_id"), "text").select("page_id", "book_id", "word")


def words_of(df: DataFrame, text: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn("word", F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), 0)))


def check_sql(views: str, body: str) -> str:
    """``body`` for the check engine with the named views before it."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    return "WITH " + ", ".join(f"{n} AS ({(VIEWS | CHECK_VIEWS)[n]})" for n in names) + "\n" + body if names else body
