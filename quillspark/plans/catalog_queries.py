"""Catalog queries over the library views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.plans.registry import query


def shelf(lib):
    """Books with their categories as an array and, in place of an upload date, their number."""
    return lib.books_v.withColumn("categories", F.array("cat1", "cat2"))


BOOK = "id, title, author, volume, status, visibility"


@query("book_by_hash", "books_v", f"SELECT {BOOK} FROM books_v WHERE content_hash = md5('src7')")
def book_by_hash(lib):
    return C.lookup(lib.books_v, content_hash=__import__("hashlib").md5(b"src7").hexdigest(), unheard_of=1).select(*BOOK.split(", "))


@query("pages_of_book", "pages_v", "SELECT id, page_number FROM pages_v WHERE book_id = 'src3' ORDER BY page_number LIMIT 20 OFFSET 5")
def pages_of_book(lib):
    return C.scan(C.lookup(lib.pages_v, book_id="src3"), "page_number", 5, 20).select("id", "page_number")


@query("page_by_key", "pages_v", "SELECT id, book_id, page_number FROM pages_v WHERE book_id = 'src3' AND page_number = 4")
def page_by_key(lib):
    return C.lookup(lib.pages_v, book_id="src3", page_number=4).select("id", "book_id", "page_number")


@query("chunks_of_book", "chunks_v", "SELECT id, page_number, chunk_index FROM chunks_v WHERE book_id = 'src3' ORDER BY page_number, chunk_index LIMIT 12")
def chunks_of_book(lib):
    return C.lookup(lib.chunks_v, book_id="src3").orderBy("page_number", "chunk_index").limit(12).select("id", "page_number", "chunk_index")


@query("books_in_list", "books_v", "SELECT id FROM books_v WHERE id IN ('src1', 'src12', 'src99')")
def books_in_list(lib):
    return lib.books_v.where(C.among("id", ["src1", "src12", "src99"])).select("id")


@query("books_of_categories", "books_v", "SELECT id FROM books_v WHERE list_has_any([cat1, cat2], ['poetry', 'drama'])")
def books_of_categories(lib):
    return shelf(lib).where(C.overlaps("categories", ["poetry", "drama"])).select("id")


@query("books_with_category", "books_v", "SELECT id FROM books_v WHERE list_contains([cat1, cat2], 'novel')")
def books_with_category(lib):
    return shelf(lib).where(F.array_contains("categories", "novel")).select("id")


@query("catalog_search_words", "books_v", """
SELECT id FROM books_v WHERE (contains(lower(title), 'work') OR coalesce(contains(lower(author), 'work'), false) OR contains(lower(cat1 || ',' || cat2), 'work'))
 AND (contains(lower(title), 'poetry') OR coalesce(contains(lower(author), 'poetry'), false) OR contains(lower(cat1 || ',' || cat2), 'poetry'))""")
def catalog_search_words(lib):
    return shelf(lib).where(C.search("WORK poetry")).select("id")


@query("catalog_search_volume", "books_v", "SELECT id FROM books_v WHERE (contains(lower(title), 'author') OR coalesce(contains(lower(author), 'author'), false)) AND volume = 2")
def catalog_search_volume(lib):
    return shelf(lib).where(C.search("author 2")).select("id")


@query("title_or_author_like", "books_v", "SELECT id FROM books_v WHERE (title ILIKE '%thor%' OR coalesce(author ILIKE '%thor%', false)) AND volume = 1")
def title_or_author_like(lib):
    return lib.books_v.where(C.title_or_author("thor 1")).select("id")


@query("visibility_guest", "books_v", "SELECT id FROM books_v WHERE status = 'ready' AND (visibility IS NULL OR visibility = 'public')")
def visibility_guest(lib):
    return lib.books_v.where(C.visible(staff=False)).select("id")


@query("visibility_staff", "books_v", "SELECT id FROM books_v")
def visibility_staff(lib):
    return lib.books_v.where(C.visible(staff=True)).select("id")


@query("listing_page", "books_v", "SELECT id, title FROM books_v ORDER BY title NULLS LAST, id LIMIT 5 OFFSET 5")
def listing_page(lib):
    return C.page_of(lib.books_v, C.listing_order("title", False, "n"), 2, 5).select("id", "title")


@query("series_sorted_books", "books_v", """
SELECT id, max(n) OVER (PARTITION BY title, author) AS latest, row_number() OVER (PARTITION BY title, author ORDER BY volume NULLS FIRST, id) AS nth FROM books_v""")
def series_sorted_books(lib):
    return C.series_sorted(lib.books_v, "n").select("id", "latest", F.col("nth").cast("long").alias("nth"))


@query("series_page", "books_v", "SELECT id FROM (SELECT *, max(n) OVER (PARTITION BY title, author) AS latest FROM books_v) ORDER BY latest DESC NULLS LAST, title NULLS FIRST, author NULLS LAST, volume NULLS FIRST, id LIMIT 5 OFFSET 5")
def series_page(lib):
    return C.series_sorted(lib.books_v, "n").offset(5).limit(5).select("id")


@query("distinct_works", "books_v", "SELECT id, title, author FROM (SELECT *, row_number() OVER (PARTITION BY title, author ORDER BY n DESC, id) AS k FROM books_v) WHERE k = 1")
def distinct_works(lib):
    return C.latest_of_works(lib.books_v, "n").select("id", "title", "author")


@query("sister_volumes", "books_v", """
SELECT b.id, b.volume FROM books_v b JOIN (SELECT title, author FROM books_v WHERE id = 'src4') a
ON b.title IS NOT DISTINCT FROM a.title AND b.author IS NOT DISTINCT FROM a.author WHERE b.status <> 'error'""")
def sister_volumes(lib):
    return C.sister_volumes(lib.books_v, "src4").select("id", "volume")


_FACETS = "SELECT trim(c, ' \"') AS category, count(*) AS n FROM (SELECT unnest([cat1, cat2]) AS c FROM books_v) GROUP BY 1"


@query("category_facets_count", "books_v", f"{_FACETS} ORDER BY n DESC, category LIMIT 3")
def category_facets_count(lib):
    return C.category_facets(shelf(lib)).orderBy(F.col("n").desc(), "category").limit(3)


@query("category_facets_alpha", "books_v", f"{_FACETS} ORDER BY category LIMIT 10")
def category_facets_alpha(lib):
    return C.category_facets(shelf(lib)).orderBy("category").limit(10)


@query("books_by_status", "books_v", """
SELECT CASE WHEN s IN ('ocr_processing', 'ocr_done') THEN 'ocr' WHEN s = 'indexing' THEN 'embedding' ELSE s END AS status, count(*) AS n
FROM (SELECT lower(coalesce(pipeline_step, status)) AS s FROM books_v) GROUP BY 1 ORDER BY n DESC""")
def books_by_status(lib):
    return C.books_by_status(lib.books_v).orderBy(F.col("n").desc())


@query("status_dashboard", "books_v", "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "ocr_processing", "ready", "error")) + " FROM books_v")
def status_dashboard(lib):
    return lib.books_v.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "ocr_processing", "ready", "error")])


@query("work_count_distinct", "books_v", """
SELECT count(*) AS works, count(*) FILTER (WHERE status = 'ready' AND (visibility IS NULL OR visibility = 'public')) AS ready
FROM (SELECT DISTINCT title, author, status, visibility FROM books_v)""")
def work_count_distinct(lib):
    return C.work_counts(lib.books_v)


@query("work_count_guest", "books_v", """
SELECT count(*) AS works, count(*) AS ready FROM (SELECT DISTINCT title, author, status, visibility FROM books_v WHERE status = 'ready' AND (visibility IS NULL OR visibility = 'public'))""")
def work_count_guest(lib):
    return C.work_counts(lib.books_v, staff=False)


@query("books_without_summary", "books_v summaries_v", "SELECT id FROM books_v b WHERE NOT EXISTS (SELECT 1 FROM summaries_v s WHERE s.book_id = b.id)")
def books_without_summary(lib):
    return C.without_summary(lib.books_v, lib.summaries_v).select("id")


@query("summary_backfill", "books_v summaries_v", """
SELECT b.id FROM books_v b LEFT JOIN summaries_v s ON s.book_id = b.id WHERE b.status = 'ready' AND (s.book_id IS NULL OR s.summary IS NULL) ORDER BY b.id LIMIT 5""")
def summary_backfill(lib):
    return C.summary_backfill(lib.books_v, lib.summaries_v).select("id")


@query("dictionary_autocomplete", "dictionary_v", "SELECT word FROM dictionary_v WHERE starts_with(word, 'th') ORDER BY length(word), word LIMIT 20")
def dictionary_autocomplete(lib):
    return C.autocomplete(lib.dictionary_v, "Th")


@query("dictionary_stats", "dictionary_v", "SELECT count(*) AS words, max(length(word)) AS longest FROM dictionary_v")
def dictionary_stats(lib):
    return lib.dictionary_v.agg(F.count("*").alias("words"), F.max(F.length("word")).cast("long").alias("longest"))


@query("suggestions", "books_v", """
SELECT text, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY id, pos) AS nth FROM (
    SELECT id, unnest([0, 1, 2, 3]) AS pos, unnest([0, 1, 2, 2]) AS rank, unnest(['title', 'author', 'category', 'category']) AS kind,
           unnest([title, author, trim(trim(trim(cat1), '"')), trim(trim(trim(cat2), '"'))]) AS text
    FROM (SELECT * FROM books_v WHERE regexp_matches(title, 'or', 'i') OR coalesce(regexp_matches(author, 'or', 'i'), false) OR regexp_matches(cat1, 'or', 'i') OR regexp_matches(cat2, 'or', 'i') ORDER BY id LIMIT 10))
  WHERE regexp_matches(text, 'or', 'i')) WHERE nth = 1 ORDER BY rank, id, pos LIMIT 10""")
def suggestions(lib):
    return C.suggestions(shelf(lib), "or")


@query("proverb_pool", "proverbs_v", "SELECT id, text FROM proverbs_v WHERE regexp_matches(text, 'the|tion', 'i')")
def proverb_pool(lib):
    return C.proverb_pool(lib.proverbs_v, ["THE", "tion"], "No proverb.")


@query("random_pivot", "events_v", "SELECT id, page_id FROM events_v WHERE NOT processed AND id >= (SELECT CAST(floor(min(id) + (max(id) - min(id) + 1) * 0.37) AS BIGINT) FROM events_v WHERE NOT processed) ORDER BY id LIMIT 1")
def random_pivot(lib):
    return C.random_pivot(lib.events_v.where("NOT processed"), 0.37).select("id", "page_id")


@query("users_search", "users_v", "SELECT id, email FROM users_v WHERE role = 'editor' AND is_active AND (contains(email, '12') OR contains(lower(display_name), '12'))")
def users_search(lib):
    return C.users_matching(lib.users_v, role="editor", active=True, q="12").select("id", "email")


@query("users_count", "users_v", "SELECT role, count(*) AS n, count(*) FILTER (WHERE is_active) AS active FROM users_v GROUP BY role")
def users_count(lib):
    return lib.users_v.groupBy("role").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query("user_by_email", "users_v", "SELECT id FROM users_v WHERE email = (SELECT max(email) FROM users_v)")
def user_by_email(lib):
    one = lib.users_v.agg(F.upper(F.max("email")).alias("e"))
    return lib.users_v.join(F.broadcast(one), F.lower("email") == F.lower("e"), "left_semi").select("id")


@query("contact_list", "contact_v", "SELECT id, created_at FROM contact_v WHERE status = 'new' ORDER BY created_at DESC, id LIMIT 25")
def contact_list(lib):
    return C.lookup(lib.contact_v, status="new").orderBy(F.col("created_at").desc(), "id").limit(25).select("id", "created_at")


@query("content_hash_dups", "", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(lib):
    return C.duplicate_contents(lib.documents.withColumnRenamed("doc_id", "id"))


@query("discovery_scan", "pages_v", """
SELECT file_name, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY file_name) AS k
 FROM (SELECT 'f' || id || '.pdf' AS file_name, sha256(text) AS content_hash, id FROM pages_v) f
 WHERE file_name NOT IN (SELECT 'f' || id || '.pdf' FROM pages_v WHERE id % 3 = 0) AND content_hash NOT IN (SELECT sha256(text) FROM pages_v WHERE id % 3 = 0)) WHERE k = 1""")
def discovery_scan(lib):
    files = lib.texts_v.select("id", F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("file_name"), F.sha2("text", 256).alias("content_hash"))
    return C.unknown_files(files, files.where("id % 3 = 0")).select("file_name", "content_hash")


@query("page_stubs", "books_v", "SELECT id AS book_id, CAST(unnest(range(1, total_pages + 1)) AS INT) AS page_number FROM books_v")
def page_stubs(lib):
    return C.page_stubs(lib.books_v)


@query("full_book_text", "pages_v", "SELECT book_id, md5(trim(string_agg('[[PAGE ' || page_number || ']]' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number))) AS digest FROM pages_v GROUP BY book_id")
def full_book_text(lib):
    return C.text_digests(C.full_texts(lib.pages_v))


@query("integrity_violations", "pages_v", "SELECT 'unique book_id,page_number' AS \"constraint\", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'retries', count(*) FILTER (WHERE retry_count > 3) FROM pages_v UNION ALL SELECT 'ocr', count(*) FILTER (WHERE ocr_milestone NOT IN ('idle', 'succeeded', 'failed')) FROM pages_v")
def integrity_violations(lib):
    from quillspark.operators.merge import violations

    return violations(lib.pages_v, [["book_id", "page_number"]], {"retries": F.col("retry_count") <= 3, "ocr": F.col("ocr_milestone").isin("idle", "succeeded", "failed")})
