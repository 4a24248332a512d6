"""Retrieval for answers: context assembly, its metrics, entities in questions, intents, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.intent_words import BECOMES, CONTENT_SIGNALS, ENDS_AE, PHRASES, PRONOUNS, PUNCTUATION, WHAT_ABOUT
from quillspark.functions.text import match_form

# Fixed values of the agent.
MOST_CHUNKS, ENOUGH_CHUNKS, MOST_STEPS, LAST_TURNS = 15, 8, 4, 6
BETWEEN, NOTHING, NO_HISTORY = "\n\n---\n\n", "No relevant context found.", "No previous conversation."
#: The category of history, and those that a search in it also takes in.
HISTORY, HISTORY_TOO = "تارىخ", ("ئۇيغۇر تارىخى", "ئىسلام تارىخى")


def ranked_context(observed: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """Of observed chunks (query_id, obs_idx, chunk_idx, book_id, page_number, score, ..) each page's first, best scores first.

    The first-seen chunk of a page stays even if a later one scores better; equal scores keep their order. ``rank`` numbers
    what is kept, at most ``most`` for each query.
    """
    seen = F.row_number().over(W.partitionBy("query_id", "book_id", "page_number").orderBy("obs_idx", "chunk_idx"))
    first = observed.withColumn("seen", seen).where("seen = 1").drop("seen")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "obs_idx", "chunk_idx"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most)


def assembled_context(ranked: DataFrame, text: str = "text", lead: DataFrame | None = None) -> DataFrame:
    """(query_id, context, book_ids): texts in rank order between rules, after any lead texts (query_id, seq, text)."""
    rows = ranked.select("query_id", F.lit(1).alias("part"), F.col("rank").alias("seq"), F.col(text).alias("text"), "book_id")
    if lead is not None:
        rows = rows.unionByName(lead.select("query_id", F.lit(0).alias("part"), "seq", "text", F.lit(None).cast("string").alias("book_id")))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "text"))).alias("t"), F.array_sort(F.collect_set("book_id")).alias("book_ids"))
    whole = F.array_join(F.transform("t", lambda x: x["text"]), BETWEEN)
    return parts.select("query_id", F.when(F.trim(whole) == "", NOTHING).otherwise(whole).alias("context"), "book_ids")


def retrieval_metrics(observed: DataFrame, tools: DataFrame) -> DataFrame:
    """(query_id, n_chunks, mean_score, scores, n_steps, tools, n_searches, n_final): raw chunks count each time they are seen.

    ``scores`` are theirs in the order in which they were observed.
    """
    order = F.array_sort(F.collect_list(F.struct("obs_idx", "chunk_idx", "score")))
    chunks = observed.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.avg("score").alias("mean_score"), F.transform(order, lambda x: x["score"]).alias("scores"))
    final = ranked_context(observed).groupBy("query_id").agg(F.count("*").alias("n_final"))
    used = tools.groupBy("query_id").agg(F.max("step").alias("n_steps"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.count_if(F.col("tool").startswith("search")).alias("n_searches"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return used.join(chunks, "query_id", "left").join(final, "query_id", "left").select("query_id", zero("n_chunks"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores"), "n_steps", "tools", "n_searches", zero("n_final"))


def steps_taken(steps: DataFrame) -> DataFrame:
    """Agent steps (query_id, step, n_calls, n_chunks) up to where the agent stops: no call, enough chunks, or the last step."""
    so_far = F.sum("n_chunks").over(W.partitionBy("query_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    idle = F.count_if(F.col("n_calls") == 0).over(W.partitionBy("query_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    return steps.withColumns({"so_far": F.coalesce(so_far, F.lit(0)), "idle": F.coalesce(idle, F.lit(0))}).where((F.col("so_far") < ENOUGH_CHUNKS) & (F.col("idle") == 0) & (F.col("step") <= MOST_STEPS)).drop("so_far", "idle")


def question_words(question: Column) -> Column:
    return F.transform(F.split(F.btrim(question), r"(?U)\s+"), lambda w: F.btrim(match_form(w), F.lit(PUNCTUATION)))


def entity_in(entity: Column, words: Column) -> Column:
    """Whether every word of an entity begins some question word; a single word needs four letters.

    A word that ends in U+06D5 also begins with U+06CC in its place.
    """
    parts = F.filter(F.split(F.btrim(match_form(entity)), r"(?U)\s+"), lambda w: w != "")
    bent = lambda w: F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit(BECOMES))
    begins = lambda w: F.exists(words, lambda q: q.startswith(w) | (F.endswith(w, F.lit(ENDS_AE)) & q.startswith(bent(w))))
    return F.coalesce((F.size(parts) > 0) & ~((F.size(parts) == 1) & (F.length(parts[0]) < 4)) & F.forall(parts, begins), F.lit(False))


def named_in(questions: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """(question_id, name): entities that questions (question_id, words) name, each pair once.

    An entity's first word, as it is and with its end bent, is the beginning of some question word. So both are joined on
    that beginning, of all of the beginnings of question words, and what meets is compared in full: no pair of a question and
    an entity is looked at that doesn't share one.
    """
    first = F.element_at(F.filter(F.split(F.btrim(match_form(F.col(name))), r"(?U)\s+"), lambda w: w != ""), 1)
    bent = F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(BECOMES))
    keys = F.array_distinct(F.when(F.endswith(first, F.lit(ENDS_AE)), F.array(first, bent)).otherwise(F.array(first)))
    of = entities.where(first.isNotNull()).select(name, F.explode(keys).alias("__key"))
    word = F.col("__word")
    each = questions.select("question_id", "words", F.explode(F.array_distinct("words")).alias("__word")).where(F.length("__word") > 0)
    begun = each.select("question_id", "words", F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, F.lit(1), i))).alias("__key")).distinct()
    return begun.join(of, "__key").where(entity_in(F.col(name), F.col("words"))).select("question_id", name).distinct()


def quoted_title(question: Column) -> Column:
    """The title between « and », or null."""
    return F.nullif(F.btrim(F.regexp_extract(question, "«([^»]+)»", 1)), F.lit(""))


def titles_in(questions: DataFrame, books: DataFrame, fuzzy_after_quote: bool = False) -> DataFrame:
    """(question_id, title): the first title, by letter, that a question names.

    A quoted title must match whole; only with ``fuzzy_after_quote`` does a quote that matches nothing fall back to words.
    """
    titles = books.where("title IS NOT NULL").select("title").distinct()
    q = questions.select("question_id", question_words(F.col("question")).alias("words"), quoted_title(F.col("question")).alias("quoted"))
    quoted = q.where("quoted IS NOT NULL").join(titles.withColumn("m", match_form(F.col("title"))), match_form(F.col("quoted")) == F.col("m")).select("question_id", "title")
    open_to_words = q.join(quoted.select("question_id"), "question_id", "left_anti") if fuzzy_after_quote else q.where("quoted IS NULL")
    found = quoted.unionByName(named_in(open_to_words, titles, "title"))
    return found.groupBy("question_id").agg(F.min("title").alias("title"))


def authors_in(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(question_id, author): the first author, by letter, whom a question names."""
    authors = books.where("author IS NOT NULL").select("author").distinct()
    q = questions.select("question_id", question_words(F.col("question")).alias("words"))
    return named_in(q, authors, "author").groupBy("question_id").agg(F.min("author").alias("author"))


def author_of_title(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(question_id, title, author) of the work that a question names."""
    of = books.where("author IS NOT NULL").groupBy("title").agg(F.min("author").alias("author"))
    return titles_in(questions, books).join(of, "title").select("question_id", "title", "author")


def books_of_author(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(question_id, author, id, title, volume) of the author a question names; ``position`` orders them, no volume first."""
    found = authors_in(questions, books).join(books, "author")
    order = W.partitionBy("question_id").orderBy(F.col("volume").asc_nulls_first(), "title", "id")
    return found.select("question_id", "author", "id", "title", "volume", F.row_number().over(order).alias("position"))


def volumes_of_title(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(question_id, title, volumes, pages) of the work a question names; a quote that matches nothing falls back to words."""
    of = books.groupBy("title").agg(F.count("*").alias("volumes"), F.sum("total_pages").alias("pages"))
    return titles_in(questions, books, fuzzy_after_quote=True).join(of, "title").select("question_id", "title", "volumes", "pages")


def catalog_context(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(question_id, kind, name): what of the catalog a question is answered with: the title it names, else the author it names, else all.

    ``catalog_lists`` has each list once; a question only refers to one, so no list is copied to questions.
    """
    by_title = titles_in(questions, books, fuzzy_after_quote=True).select("question_id", F.lit("title").alias("kind"), F.col("title").alias("name"))
    by_author = authors_in(questions, books).join(by_title.select("question_id"), "question_id", "left_anti").select("question_id", F.lit("author").alias("kind"), F.col("author").alias("name"))
    known = by_title.unionByName(by_author)
    rest = questions.select("question_id").join(known.select("question_id"), "question_id", "left_anti")
    return known.unionByName(rest.select("question_id", F.lit("all").alias("kind"), F.lit(None).cast("string").alias("name")))


def catalog_lists(books: DataFrame) -> DataFrame:
    """(kind, name, title, volume, id, label): the lines of every list, one row a line; a list is in order of title, volume, id.

    Books that aren't ready say so. A book is in three lists at most: its title's, its author's, and the one of all.
    """
    label = F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" / "), F.col("author")), F.lit("")), F.when(F.col("status") != "ready", F.concat(F.lit(" [Status: "), "status", F.lit("]"))).otherwise(""))
    lists = F.array(F.struct(F.lit("title").alias("kind"), F.col("title").alias("name")), F.struct(F.lit("author").alias("kind"), F.col("author").alias("name")), F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("name")))
    each = books.select(F.explode(lists).alias("l"), "title", "volume", "id", label.alias("label"))
    return each.select("l.*", "title", "volume", "id", "label").where("kind = 'all' OR name IS NOT NULL")


def intent(question: Column, has_history: Column, is_global: Column) -> Column:
    """The handler that answers a question: the first whose phrases it has."""
    q = match_form(F.btrim(question))
    said = lambda phrases, text=q: reduce(Column.__or__, [text.contains(match_form(F.lit(p))) for p in phrases])
    words = F.split(q, r"(?U)\s+")
    refers = F.arrays_overlap(words, F.array(*[match_form(F.lit(p)) for p in PRONOUNS])) | F.exists(words, lambda w: F.endswith(w, match_form(F.lit(WHAT_ABOUT))))
    ladder = [(name, said(PHRASES[name])) for name in ("identity", "capabilities", "author_by_title", "books_by_author", "volume_info")]
    ladder += [("follow_up", has_history & (said(PHRASES["follow_up"]) | refers))]
    raw = F.btrim(question)
    ladder += [(name, ~is_global & said(PHRASES[name], raw)) for name in ("current_page", "current_volume")]
    for name, found in reversed(ladder):
        out = F.when(F.coalesce(found, F.lit(False)), name).otherwise(out if name != ladder[-1][0] else F.lit("agent_rag"))
    return out


def is_catalog_question(question: Column) -> Column:
    q = match_form(F.btrim(question))
    said = lambda phrases: reduce(Column.__or__, [q.contains(match_form(F.lit(p))) for p in phrases])
    return F.coalesce(said(PHRASES["catalog"]) & ~said(CONTENT_SIGNALS), F.lit(False))


def history_lines(turns: DataFrame, last: int = LAST_TURNS, asking: DataFrame | None = None) -> DataFrame:
    """(conv_id, history): the last turns as ``User: ..`` and ``AI: ..`` lines; ``asking`` (conv_id) may name conversations without any."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    who = F.when(F.col("role") == "user", "User").otherwise("AI")
    line = F.concat(who, F.lit(": "), F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    kept = turns.withColumn("nth", nth).where(F.col("nth") <= last).select("conv_id", "turn", line.alias("line"))
    of = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    found = of.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history"))
    if asking is None:
        return found
    return asking.select("conv_id").distinct().join(found, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit(NO_HISTORY)))


def with_history_categories(categories: Column, history: str = HISTORY, more: tuple = HISTORY_TOO) -> Column:
    return F.when(F.array_contains(categories, history), F.array_union(categories, F.array(*map(F.lit, more)))).otherwise(categories)


def summaries_of(summaries: DataFrame, books: DataFrame, book_ids: list[str], terms: list[str] | None = None) -> DataFrame:
    """Summaries of books with their metadata; with terms, those that have any of them."""
    found = summaries.where(F.col("book_id").isin(book_ids) & F.col("summary").isNotNull())
    if terms:
        found = found.where(reduce(Column.__or__, [F.ilike("summary", F.lit(f"%{t}%")) for t in terms]))
    return found.join(books.select(F.col("id").alias("book_id"), "title", "author", "volume"), "book_id")
