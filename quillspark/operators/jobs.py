"""Page jobs and administration as DataFrame functions: what tables are after a job's results, an edit or a reset.

A job is two steps: its work, a DataFrame of results with an ``error`` column (``worked``), and what results do to pages and
the outbox (``settled``, ``outcome_events``). So a failing page costs its own row, and the state machine stays declarative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.chunking import chunks
from quillspark.functions.spelling import apply_edits
from quillspark.functions.text import cleaned, normalize, normalize_markdown, strip_markdown, text_column
from quillspark.operators.merge import STEPS, upserted, word_added
from quillspark.operators.pipeline import DONE, book_milestones

# Characters of an error that are kept; status codes after which a call is tried again, and the first wait.
ERROR_CHARS, TRY_AGAIN, FIRST_WAIT = 500, (429, 503), 2.0


def worked(pages: DataFrame, work: Callable[[str | None], object], kind: T.DataType, name: str = "result", text: str = "text") -> DataFrame:
    """(id, ``name``, error): ``work`` of each page's text; an exception becomes the page's error, cut to 500 characters."""
    schema = T.StructType().add("id", T.LongType()).add(name, kind).add("error", T.StringType())
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    result, error = work(t), None
                except Exception as e:
                    result, error = None, str(e)[:ERROR_CHARS]
                results.append(result)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(results, out.field(1).type), pa.array(errors, pa.string())], schema=out)

    return pages.select("id", text).mapInArrow(run, schema)


def chunked(pages: DataFrame, split: Callable[[str], list[str]] = chunks) -> DataFrame:
    """(id, result, error): the chunks of each page's cleaned text; pages of contents have none and never fail."""
    texts = pages.select("id", F.when(~F.coalesce("is_toc", F.lit(False)), F.coalesce("text", F.lit(""))).alias("text"))
    return worked(texts, lambda t: [] if t is None else split(cleaned(t)), T.ArrayType(T.StringType()))


def settled(pages: DataFrame, results: DataFrame, step: str) -> DataFrame:
    """Pages after a job's results (id, error): succeeded, or failed with one retry more and the error; others as they were."""
    done = results.select("id", F.col("error").alias("__error"), F.lit(True).alias("__ran"))
    both = pages.join(done, "id", "left")
    failed = F.col("__ran") & F.col("__error").isNotNull()
    values = {f"{step}_milestone": F.when(failed, "failed").when(F.col("__ran"), DONE[step]).otherwise(F.col(f"{step}_milestone"))}
    values["retry_count"] = F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    before = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    values["error"] = F.when(failed, F.col("__error")).otherwise(before)
    if step == "embedding" and "is_indexed" in pages.columns:
        values["is_indexed"] = F.when(F.col("__ran") & ~failed, True).otherwise(F.col("is_indexed"))
    return both.withColumns(values).drop("__error", "__ran")


def outcome_events(results: DataFrame, step: str) -> DataFrame:
    """(page_id, event_type, payload): ``step_succeeded``, or ``step_failed`` with the error as JSON."""
    failed = F.col("error").isNotNull()
    payload = F.when(failed, F.to_json(F.struct("error")))
    return results.select(F.col("id").alias("page_id"), F.when(failed, f"{step}_failed").otherwise(f"{step}_succeeded").alias("event_type"), payload.alias("payload"))


def rechunked_pages(chunk_rows: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks after a chunking job: a succeeded page's texts by index without vectors, its higher indexes gone, all else as it was."""
    of = results.where("error IS NULL").join(pages.select("id", "book_id", "page_number"), "id")
    new = of.select("book_id", "page_number", F.posexplode("result").alias("chunk_index", "text"))
    others = chunk_rows.join(of.select("book_id", "page_number"), ["book_id", "page_number"], "left_anti")
    keys = ["book_id", "page_number", "chunk_index"]
    old = chunk_rows.select(*keys, *[F.col(c) for c in chunk_rows.columns if c not in (*keys, "text", "embedding")])
    merged = new.join(old, keys, "left").withColumn("embedding", F.lit(None).cast(chunk_rows.schema["embedding"].dataType))
    return others.unionByName(merged.select(*chunk_rows.columns))


def books_refreshed(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Books with their milestones as their pages now have them; books without pages keep theirs."""
    names = [f"{s}_milestone" for s in STEPS if f"{s}_milestone" in books.columns]
    now = book_milestones(pages).select(F.col("book_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in names])
    return books.join(now, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])


def until_empty(claim: Callable[[], DataFrame], handle: Callable[[DataFrame], None], most_rounds: int = 1000) -> int:
    """Claims and handles batches until a claim is empty; gives the number of batches. Claims are bounded by their own limits."""
    for n in range(most_rounds):
        batch = claim()
        if not batch.limit(1).count():
            return n
        handle(batch)
    raise RuntimeError(f"still work after {most_rounds} batches")


def tried(call: Callable, *args, tries: int = 4, wait: Callable[[float], None] | None = None):
    """The result of a call that is tried again, after waits that double, where it fails with a status of ``TRY_AGAIN``."""
    import time

    for k in range(tries):
        try:
            return call(*args)
        except Exception as e:
            status = getattr(e, "code", getattr(e, "status_code", None))
            if status not in TRY_AGAIN or k == tries - 1:
                raise
            (wait or time.sleep)(FIRST_WAIT * 2**k)


# Corrections.


def rule_of(rules: DataFrame, word: str) -> DataFrame:
    return rules.where(F.col("misspelled_word") == word)


def active_rules(rules: DataFrame, auto_only: bool = True) -> DataFrame:
    """(word, new): what active rules (or all) make of a word."""
    return (rules.where("is_active") if auto_only else rules).select(F.col("misspelled_word").alias("word"), F.col("corrected_word").alias("new"))


def rules_matching(rules: DataFrame, search: str | None = None, auto_only: bool = False) -> DataFrame:
    """Rules whose word, correction or description has ``search``, whatever the case, in order of word, then id.

    ``%`` and ``_`` stand for any characters and for one. A page is a slice of it, the total its count.
    """
    found = rules.where("is_active") if auto_only else rules
    if search:
        like = lambda c: F.coalesce(F.ilike(F.col(c), F.lit(f"%{search}%")), F.lit(False))
        found = found.where(reduce(Column.__or__, [like(c) for c in ("misspelled_word", "corrected_word", "description") if c in rules.columns]))
    return found.orderBy(F.lower("misspelled_word"), *(["id"] if "id" in rules.columns else []))


def rules_patched(rules: DataFrame, patch: DataFrame) -> DataFrame:
    """Rules after a patch by word: fields that the patch lacks or has as null stay; unknown words are not added."""
    names = [c for c in patch.columns if c != "misspelled_word" and c in rules.columns]
    new = patch.select("misspelled_word", *[F.col(c).alias(f"__{c}") for c in names])
    return rules.join(new, "misspelled_word", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*rules.columns)


def rules_saved(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """Rules with ``rows`` (misspelled_word, corrected_word) created, or set and made active again."""
    return upserted(rules, rows.select("misspelled_word", "corrected_word", F.lit(True).alias("is_active")), ["misspelled_word"])


def corrected_pages(pages: DataFrame, issues: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, issues) after automatic corrections.

    A page's issues in processing are taken; where it has none, its open ones whose word has a rule. Those with offsets and a
    rule are made and are corrected then, but for those whose places overlap others; changed pages go back to chunking and
    embedding.
    """
    known = active_rules(rules)
    busy = issues.where("status = 'processing'").select(F.col("page_id").alias("__busy")).distinct()
    placed = "char_offset IS NOT NULL AND char_end IS NOT NULL AND status IN ('processing', 'open')"
    taken = F.when(F.col("__busy").isNotNull(), F.col("status") == "processing").otherwise(F.col("status") == "open")
    # Rules first, so that only issues that may become edits are dealt out by page.
    edits = issues.where(placed).join(known, "word").join(busy, F.col("page_id") == F.col("__busy"), "left").where(taken)
    new = apply_edits(pages, edits.select("page_id", F.col("char_offset").alias("start"), F.col("char_end").alias("end"), "new"))
    # What issues need to know of their pages is a row a page, so all of them are dealt out by page alone, and once.
    left = new.where(F.size("overlaps") > 0).select(F.col("id").alias("__page"), F.col("overlaps").alias("__left"))
    state = issues.join(known, "word", "left").join(busy, F.col("page_id") == F.col("__busy"), "left").join(left, F.col("page_id") == F.col("__page"), "left")
    hit = F.coalesce(F.expr(placed) & taken & F.col("new").isNotNull(), F.lit(False))
    edit = F.struct(F.col("char_offset").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), F.col("new").alias("new"))
    made = hit & F.when(hit & F.col("__left").isNotNull(), ~F.array_contains("__left", edit)).otherwise(True)
    after = state.withColumn("status", F.when(made, "corrected").otherwise(F.col("status"))).select(*issues.columns)
    return _stale_index(new), after


def _not_made(edited: DataFrame) -> DataFrame:
    left = edited.select(F.col("id").alias("__page"), F.explode("overlaps").alias("e"))
    return left.select("__page", F.col("e.start").alias("__start"), F.col("e.end").alias("__end"), F.col("e.new").alias("__new"))


def _stale_index(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_indexed", F.col("is_indexed") & (F.col("n_edits") == 0)) if "is_indexed" in pages.columns else pages


def manual_corrections(pages: DataFrame, issues: DataFrame, rules: DataFrame, dictionary: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, issues, rules, dictionary) after an editor's corrections.

    ``asked`` has issue_id, corrected_word, start, end (null: the issue's own), original_word (null: the issue's), as_rule and
    to_dictionary. Issues without any range are left out. Rules are created or made active; of several for one word the
    first by issue counts. Words new to the dictionary are added, and their open issues anywhere ignored.
    """
    own = issues.select(F.col("id").alias("issue_id"), "page_id", "word", "char_offset", "char_end")
    both = asked.join(own, "issue_id").withColumn("__word", F.coalesce("original_word", "word"))
    start, end = (F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col(a)).otherwise(F.col(b)) for a, b in (("start", "char_offset"), ("end", "char_end")))
    edits = both.select("issue_id", "page_id", start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("corrected_word").alias("new")).where("start IS NOT NULL AND end IS NOT NULL")
    saved = both.where("as_rule").groupBy(F.col("__word").alias("misspelled_word")).agg(F.min_by("corrected_word", "issue_id").alias("corrected_word"))
    added = both.where("to_dictionary").select(F.col("__word").alias("word")).distinct().join(dictionary.select("word"), "word", "left_anti")
    grown, after = word_added(dictionary, issues, added)
    new = apply_edits(pages, edits.drop("issue_id"))
    made = edits.join(_not_made(new), [F.col("page_id") == F.col("__page"), F.col("start") == F.col("__start"), F.col("end") == F.col("__end"), F.coalesce("new", F.lit("")) == F.col("__new")], "left_anti")
    done = made.select(F.col("issue_id").alias("id"), F.lit(True).alias("__done")).distinct()
    after = after.join(done, "id", "left").withColumn("status", F.when(F.col("__done"), "corrected").otherwise(F.col("status"))).select(*issues.columns)
    return _stale_index(new), after, rules_saved(rules, saved), grown


# Page administration.


def page_reset(pages: DataFrame, book_id: str, page_number: int) -> DataFrame:
    """A page is to be recognised again: no text, no index, no retries used, pending at its first step."""
    hit = (F.col("book_id") == book_id) & (F.col("page_number") == page_number)
    to = {"status": F.lit("pending"), "text": F.lit(None), "is_indexed": F.lit(False), "pipeline_step": F.lit("ocr"), "milestone": F.lit("idle"), "ocr_milestone": F.lit("idle"), "retry_count": F.lit(0)}
    return pages.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in to.items() if c in pages.columns})


def bulk_reset(books: DataFrame, pages: DataFrame, include_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """(books, pages) once all books whose recognition has not ``succeeded`` start over.

    A book's milestone is called ``complete``, never ``succeeded``, so as in the surveyed system every book with a milestone
    is reset, but for ready ones and those in error, unless ``include_error``.
    """
    which = F.col("ocr_milestone") != "succeeded"
    which = which if include_error else which & ~F.col("status").isin("ready", "error")
    chosen = books.where(which).select(F.col("id").alias("book_id"), F.lit(True).alias("__hit"))
    idle = {f"{s}_milestone": F.lit("idle") for s in STEPS}

    def reset(rows: DataFrame, key: str, to: dict) -> DataFrame:
        both = rows.join(chosen.withColumnRenamed("book_id", key), key, "left")
        return both.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in to.items() if c in rows.columns}).select(*rows.columns)

    new_books = reset(books, "id", idle | {"status": F.lit("pending"), "pipeline_step": F.lit("ocr")})
    return new_books, reset(pages, "book_id", idle | {"retry_count": F.lit(0), "is_indexed": F.lit(False)})


def edited(pages: DataFrame, issues: DataFrame, chunk_rows: DataFrame, edits: DataFrame, model: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, issues, chunks) after manual edits (id, text).

    Texts are normalised. A page whose text changes loses its issues and is to be spell-checked again. Every edited page is
    chunked anew from its text without markdown, as one chunk where splitting gives none; a page left without text keeps its
    chunks. With a ``model`` the new chunks are embedded at once and the page is indexed, else it waits for its embedding.
    """
    from quillspark.functions.models import embed_missing

    new = edits.select("id", normalize(normalize_markdown(F.coalesce("text", F.lit("")))).alias("__text"))
    both = pages.join(new, "id", "left")
    hit = F.col("__text").isNotNull()
    changed = F.coalesce(hit & ~F.col("text").eqNullSafe(F.col("__text")), F.lit(False))
    plain = strip_markdown(F.col("__text"))
    whole = F.coalesce(hit & (plain != ""), F.lit(False))
    through = hit & (~whole | F.lit(model is not None))
    out = both.withColumns({"__changed": changed, "__plain": plain, "__whole": whole, "__through": through})
    set_to = {
        "spell_check_milestone": (F.col("__changed"), F.lit("idle")),
        "chunking_milestone": (F.col("__whole"), F.lit("succeeded")),
        "embedding_milestone": (hit, F.when(F.col("__through"), "succeeded").otherwise("idle")),
        "is_indexed": (hit, F.col("__through") | (F.lit(False) if model is None else F.lit(True))),
        "pipeline_step": (hit, F.when(F.col("__through"), "embedding").otherwise("chunking")),
        "status": (hit, F.when(F.col("__through"), "indexed").otherwise("chunked")),
    }
    after = out.withColumns({c: F.when(F.coalesce(when, F.lit(False)), v).otherwise(F.col(c)) for c, (when, v) in set_to.items() if c in pages.columns})
    after = after.withColumn("text", F.coalesce("__text", "text")).select(*pages.columns)
    stale = out.where("__changed").select(F.col("id").alias("page_id"))
    split = text_column(lambda t: [c for c in chunks(t) if c.strip()] or [t], "array<string>")
    pieces = out.where("__whole").select("book_id", "page_number", split(F.col("__plain")).alias("c"))
    fresh = pieces.select("book_id", "page_number", F.posexplode("c").alias("chunk_index", "text"))
    kept = chunk_rows.join(pieces.select("book_id", "page_number"), ["book_id", "page_number"], "left_anti")
    for c in chunk_rows.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(chunk_rows.schema[c].dataType))
    fresh = fresh.select(*chunk_rows.columns)
    return after, issues.join(stale, "page_id", "left_anti").select(*issues.columns), kept.unionByName(embed_missing(fresh, model) if model else fresh)


# Handlers and tools.


def answered_first(questions: DataFrame, handlers: list[tuple[str, DataFrame]], otherwise: str = "catalog") -> DataFrame:
    """(question_id, handler): the first handler that has a row for a question, in order; else the one that answers all.

    ``handlers`` are (name, DataFrame with question_id), as ``author_of_title``, ``books_of_author`` and ``volumes_of_title`` give.
    """
    out = questions.select("question_id")
    for i, (_, found) in enumerate(handlers):
        out = out.join(found.select("question_id", F.lit(True).alias(f"__h{i}")).distinct(), "question_id", "left")
    name = F.lit(otherwise)
    for i, (handler, _) in reversed(list(enumerate(handlers))):
        name = F.when(F.col(f"__h{i}"), handler).otherwise(name)
    return out.select("question_id", name.alias("handler"))


class Tools:
    """Tools by name: functions that give DataFrames, called with named arguments."""

    def __init__(self, **tools: Callable[..., DataFrame]):
        self.tools = dict(tools)

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self.tools))}")
        return self.tools[name](**arguments)


def library_tools(books: DataFrame, pages: DataFrame, chunk_rows: DataFrame, summaries: DataFrame, embed: Callable[[str], list[float]]) -> Tools:
    """The tools of an agent over a library: searches, summaries, entities, pages and catalog."""
    from quillspark.operators import catalog as C
    from quillspark.operators import retrieval as R
    from quillspark.operators import vectors as V

    ask = lambda q: books.sparkSession.createDataFrame([(0, q)], "question_id long, question string")
    vector = lambda q: V.query_vector(embed(q))
    return Tools(
        search_chunks=lambda query, book_ids=None, categories=None, k=V.CHUNK_K, threshold=V.CHUNK_THRESHOLD: V.shaped(V.chunk_search(chunk_rows, books, pages, vector(query), book_ids, categories, k, threshold)),
        search_summaries=lambda query, categories=None, k=V.SUMMARY_K, threshold=V.SUMMARY_THRESHOLD: V.summary_search(summaries, books, vector(query), categories, k=k, threshold=threshold),
        get_summaries=lambda book_ids, terms=None: R.summaries_of(summaries, books, book_ids, terms),
        find_title=lambda question: R.titles_in(ask(question), books),
        find_author=lambda question: R.authors_in(ask(question), books),
        author_of_title=lambda question: R.author_of_title(ask(question), books),
        books_of_author=lambda question: R.books_of_author(ask(question), books),
        volumes_of_title=lambda question: R.volumes_of_title(ask(question), books),
        read_page=lambda book_id, page_number: C.lookup(pages, book_id=book_id, page_number=page_number),
        search_catalog=lambda query: books.where(C.search(query)),
    )


def classified(texts: DataFrame, choose: Callable[[str, list[str]], list[str]], categories: list[str], text: str = "text") -> DataFrame:
    """(id, categories): categories that a model chooses for each text, of those that exist alone; none where it fails."""

    def of(t: str | None) -> list[str]:
        return [c for c in dict.fromkeys(choose(t or "", categories)) if c in categories]

    return worked(texts, of, T.ArrayType(T.StringType()), "categories", text).select("id", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def structured(texts: DataFrame, answer: Callable[[str], dict], schema: T.StructType, text: str = "text") -> DataFrame:
    """(id, answer, error): a model's answer as fields of ``schema``; unknown fields are dropped, missing ones null."""

    def of(t: str | None) -> dict:
        got = answer(t or "")
        return {f.name: got.get(f.name) for f in schema}

    return worked(texts, of, schema, "answer", text)
