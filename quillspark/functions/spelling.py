"""Spelling: tokens with offsets, variants of misread words, corrections, rules and offset-safe edits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import DROPPED, HAMZA_PAIR, normalized, spelling_pattern
from quillspark.sources.store import stored

# Characters of a word, its least length, letters that recognition takes for one another, vowels it loses.
WORD_CHARS = "\u0621-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff\u200c\u200d"
LEAST_LENGTH = 4
CONFUSED = (
    ("\u0643", "\u06ad"),
    ("\u06ad", "\u0643"),
    ("\u0648", "\u06c7"),
    ("\u06c7", "\u0648"),
    ("\u06c6", "\u06c7"),
    ("\u06c7", "\u06c6"),
    ("\u06d5", "\u06be"),
    ("\u06be", "\u06d5"),
    ("\u0646", "\u06ad"),
    ("\u06af", "\u0643"),
    ("\u0643", "\u06af"),
    ("\u06cb", "\u0648"),
    ("\u0648", "\u06cb"),
    ("\u0631", "\u0632"),
    ("\u0632", "\u0631"),
    ("\u0642", "\u0641"),
    ("\u0641", "\u0642"),
    ("\u0639", "\u063a"),
    ("\u063a", "\u0639"),
    ("\u062d", "\u062e"),
    ("\u062e", "\u062d"),
)
VOWELS = ("\u06d0", "\u0649", "\u0648", "\u06c8", "\u064a", "\u0627", "\u06d5", "\u06c7", "\u06c6")

_LETTERS = "".join(c for c in map(chr, range(0x0600, 0xFF00)) if re.match(f"[{WORD_CHARS}]", c) and unicodedata.category(c)[0] in "LM")
#: From the first letter or mark of a run of word characters to its last.
_WORD = re.compile(f"[{_LETTERS}](?:[{WORD_CHARS}]*[{_LETTERS}])?")
#: Characters that ``normalized`` changes.
_CHANGED = re.compile(f"[{DROPPED}{HAMZA_PAIR}\ufb50-\ufdff\ufe70-\ufeff]")
_NO_WORD = re.compile(f"[^{WORD_CHARS}]")
#: Characters whose words are found at a time, tokens that are sent on at a time, and words that go to every task.
_CHARS, _AT_ONCE, MOST_WORDS = 500_000, 50_000, 500_000

_KINDS = np.zeros(0x110000, np.uint8)  # 1: of a word, 2: a letter or mark, 4: changed
for _c in map(chr, range(0x0600, 0xFF00)):
    _KINDS[ord(_c)] = bool(re.match(f"[{WORD_CHARS}]", _c)) + 2 * (_c in _LETTERS) + 4 * bool(_CHANGED.match(_c))


def tokens(text: str | None) -> Iterator[tuple[str, str, int, int]]:
    """Words of a text: the normalised word, what stands there, and where (code points of the raw text)."""
    for m in _WORD.finditer(text or ""):
        raw = m[0]
        word = normalized(raw) if _CHANGED.search(raw) else raw
        if len(word) >= LEAST_LENGTH:
            yield word, raw, m.start(), m.end()


def _pieces(texts: pa.Array) -> Iterator[list[tuple[int, int, str]]]:
    """(place of the text, where in it, piece), some ``_CHARS`` characters at a time; long texts are cut between words."""
    some, size = [], 0
    for place, t in enumerate(texts):
        text, at = t.as_py() or "", 0
        while at < len(text):
            end = len(text)
            if end - at > _CHARS:
                cut = _NO_WORD.search(text, at + _CHARS)
                end = cut.end() if cut else end
            some.append((place, at, text[at:end]))
            size, at = size + end - at, end
            if size >= _CHARS:
                yield some
                some, size = [], 0
    if some:
        yield some


def _token_arrays(some: list[tuple[int, int, str]]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """``tokens`` of pieces, in one go over their characters: place, word, raw, start, end."""
    size = np.array([len(t) + 1 for _, _, t in some])
    points = np.frombuffer("\n".join([t for _, _, t in some] + [""]).encode("utf-32-le"), np.uint32)
    kinds = _KINDS[points]
    inside = np.append(kinds & 1, 0).astype(np.int8)
    run_start, run_end = np.flatnonzero(np.diff(inside, prepend=0) == 1), np.flatnonzero(np.diff(inside, prepend=0) == -1)
    letters = np.flatnonzero(kinds & 2)
    first, last = np.searchsorted(letters, run_start), np.searchsorted(letters, run_end) - 1
    some_letter = first <= last
    start, end = letters[first[some_letter]], letters[last[some_letter]] + 1
    altered = np.append(0, np.cumsum(kinds >> 2 & 1))
    changed = altered[end] > altered[start]
    long = changed | (end - start >= LEAST_LENGTH)
    start, end, changed = start[long], end[long], changed[long]
    edges = np.zeros(len(points) + 1, np.int8)
    edges[start] += 1
    edges[end] -= 1
    own = np.cumsum(edges[:-1]).astype(bool)
    width = np.append(0, np.cumsum(1 + (points[own] > 0x7F) + (points[own] > 0x7FF) + (points[own] > 0xFFFF)))
    offsets = width[np.append(0, np.cumsum(end - start))].astype(np.int32)
    raw = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(points[own].tobytes().decode("utf-32-le").encode()))
    word = raw
    if changed.any():
        word = pc.replace_with_mask(raw, pa.array(changed), pa.array([normalized(w.as_py()) for w in raw.filter(pa.array(changed))], pa.string()))
    begin = np.append(0, np.cumsum(size))
    piece = np.searchsorted(begin, start, side="right") - 1
    shift = np.array([at for _, at, _ in some])[piece] - begin[piece]
    place = np.array([p for p, _, _ in some])[piece]
    if changed.any():
        kept = pc.utf8_length(word).to_numpy(zero_copy_only=False) >= LEAST_LENGTH
        place, word, raw, start, end, shift = place[kept], word.filter(pa.array(kept)), raw.filter(pa.array(kept)), start[kept], end[kept], shift[kept]
    return place, word, raw, start + shift, end + shift


def token_rows(pages: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(page_id, word, raw, start, end): one row for each word of each page, or for those that ``only`` has (word, ``MOST_WORDS`` at most).

    Pages are read in pieces of bounded size, words sent on in bounded batches.
    """
    sought = None if only is None else pages.sparkSession.sparkContext.broadcast({r["word"] for r in only.select("word").collect()})
    names = ["page_id", "word", "raw", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch.column(1)):
                place, word, raw, start, end = _token_arrays(some)
                cols = [batch.column(0).take(pa.array(place)), word, raw, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                found = pa.RecordBatch.from_arrays(cols, names=names)
                if sought is not None:
                    coded = word.dictionary_encode()
                    hit = np.array([w in sought.value for w in coded.dictionary.to_pylist()], bool)
                    found = found.filter(pa.array(hit[coded.indices.to_numpy()])) if len(word) else found
                for at in range(0, found.num_rows, _AT_ONCE):
                    yield found.slice(at, _AT_ONCE)

    return pages.select(F.col(key).cast("long").alias("page_id"), text).mapInArrow(run, "page_id long, word string, raw string, start int, end int")


def word_rows(pages: DataFrame, text: str = "text") -> DataFrame:
    """(word): the words of all pages, each once or a few times a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for some in _pieces(batch.column(0)):
                new = set(_token_arrays(some)[1].unique().to_pylist()) - seen
                seen = new if len(seen) > MOST_WORDS else seen | new
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["word"])

    return pages.select(text).mapInArrow(run, "word string")


def once_replaced(word: Column, pairs: tuple = CONFUSED) -> Column:
    """Words with one occurrence of one confused letter replaced: by pair as listed, then by place."""
    places = F.sequence(F.lit(1), F.length(word))
    at = lambda wrong, right: F.transform(
        F.filter(places, lambda i: F.substring(word, i, F.lit(1)) == wrong), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(right), F.substring(word, i + 1, F.length(word)))
    )
    return F.concat(*[at(a, b) for a, b in pairs])


def replaced(word: Column, pairs: tuple = CONFUSED) -> Column:
    """Single, then double replacements, each once, without the word itself."""
    one = F.array_distinct(F.filter(once_replaced(word, pairs), lambda v: v != word))
    two = F.flatten(F.transform(one, lambda v: once_replaced(v, pairs)))
    return F.array_distinct(F.concat(one, F.filter(two, lambda v: v != word)))


def inserted(word: Column, vowels: tuple = VOWELS) -> Column:
    """The word with one vowel more: at every place, by vowel as listed, each once."""
    places = F.sequence(F.lit(0), F.length(word))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.array(*map(F.lit, vowels)), lambda v: F.concat(F.substring(word, F.lit(1), i), v, F.substring(word, i + 1, F.length(word)))))))


def without_vowel(word: Column, vowels: tuple = VOWELS) -> Column:
    """The word with one of its vowels less, at every place, each once: what ``inserted`` turns into it."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)).isin(*vowels))
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word): distinct words that the dictionary lacks."""
    return words.select("word").distinct().join(dictionary.select("word"), "word", "left_anti")


def corrections(unknown: DataFrame, dictionary: DataFrame, vowels: tuple = VOWELS, pairs: tuple = CONFUSED) -> DataFrame:
    """(word, corrections) for unknown words with a variant in the dictionary, in the variants' order.

    Variants are made backwards, from the dictionary: of each of its words those that it is a variant of (pairs the other way
    round, a vowel less). These are joined with the unknown words, so work grows with the dictionary, not with misreadings;
    only words that have a correction make their own variants, for the order. Words without any are left out.
    """
    known = F.col("variant")
    turned = tuple((b, a) for a, b in pairs)
    back = F.concat(without_vowel(known, vowels), replaced(known, turned)) if pairs else without_vowel(known, vowels)
    from_known = dictionary.select(F.col("word").alias("variant")).distinct().select("variant", F.explode(F.array_distinct(back)).alias("word"))
    hits = unknown.select("word").distinct().join(from_known, "word").groupBy("word").agg(F.collect_set("variant").alias("__known"))
    variants = F.array_distinct(F.concat(replaced(F.col("word"), pairs), inserted(F.col("word"), vowels))) if pairs else inserted(F.col("word"), vowels)
    return hits.select("word", F.filter(variants, lambda v: F.array_contains("__known", v)).alias("corrections"))


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Whole-word replacements, longest first, one after the other."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    edge = WORD_CHARS
    rule = lambda t, r: F.regexp_replace(t, F.lit(f"(?<![{edge}]){spelling_pattern(r[0])}(?![{edge}])"), F.lit(re.sub(r"([\\$])", r"\\\1", r[1])))
    return reduce(rule, ordered, text)


def check_pages(pages: DataFrame, dictionary: DataFrame, rules: DataFrame | list[tuple[str, str]], vowels: tuple = VOWELS, pairs: tuple = CONFUSED) -> tuple[DataFrame, DataFrame]:
    """(pages with rules applied and the check done, issues): one issue for each occurrence of an unknown word with corrections.

    ``rules`` are a table (misspelled_word, corrected_word) of any number of rules, or a short list.
    """
    from quillspark.functions.rewriting import rewritten

    fixed = rewritten(pages, rules) if isinstance(rules, DataFrame) else pages.withColumn("text", apply_rules(F.col("text"), rules))
    fixed = fixed.withColumn("spell_check_milestone", F.lit("done"))
    found = stored(corrections(unknown_words(word_rows(fixed), dictionary), dictionary, vowels, pairs))
    # Few words have corrections: then only their places become rows; else all words meet them in a join.
    each = token_rows(fixed, only=found if found.count() <= MOST_WORDS else None)
    issues = each.join(found, "word").select("page_id", F.col("raw").alias("word"), F.col("start").alias("char_offset"), F.col("end").alias("char_end"), F.col("corrections").alias("ocr_corrections"), F.lit("open").alias("status"))
    return fixed, issues


def apply_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages with edits (page_id, start, end, new) made in one sweep; edits without offsets are skipped.

    ``n_edits`` counts them, ``overlaps`` lists those that were not made; changed pages go back to chunking and embedding.
    """
    from quillspark.functions.rewriting import edited

    out = edited(pages, edits)
    for step in ("chunking_milestone", "embedding_milestone"):
        if step in pages.columns:
            out = out.withColumn(step, F.when(F.col("n_edits") > 0, "idle").otherwise(F.col(step)))
    return out
