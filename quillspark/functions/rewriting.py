"""Rewriting page texts: rules held as a table, found by one automaton, and edits spliced in one sweep.

Rules are whole-word replacements made one after the other, the longest word first, so what one rule writes a later one may
rewrite. A trie of all words with failure links (built once a worker from the broadcast rules) finds every occurrence in one
pass. The occurrence whose rule comes first is made, and only the text it stands in is searched again, for rules that come
after it. That text is short: characters that neither occur in a rule nor belong to words part a page into stretches that
rewrite alone, and a worker rewrites every different stretch once. So time grows with a page's characters and the corpus's
different words, not with the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.spelling import WORD_CHARS
from quillspark.functions.text import HAMZA_LETTER, HAMZA_PAIR

#: Rules that a broadcast may hold, and rewritten stretches that a worker keeps.
MOST_RULES, KEPT = 2_000_000, 500_000

_WORD_CHAR = re.compile(f"[{WORD_CHARS}]")


class Rewriter:
    """Texts after ``rules`` (word, correction); of several with one word the least correction counts, empty words are none."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        least: dict[str, str] = {}
        for word, new in rules:
            if word:
                least[word] = min(new, least.get(word, new))
        self.rules = sorted(least.items(), key=lambda r: (-len(r[0]), r[0]))
        self.trie = ahocorasick.Automaton()
        letters: set[str] = set()
        for k, (word, _) in enumerate(self.rules):
            own = one_spelling(word)
            letters |= set(own)
            # Two words that differ by the spelling of hamza alone are one pattern; the first one's rule is made first.
            self.trie.add_word(own, [*self.trie.get(own, []), k])
        if self.rules:
            self.trie.make_automaton()
        inside = "".join(sorted(re.escape(c) for c in letters - set("ـ")))
        self.stretches = re.compile(f"[{WORD_CHARS}{inside}ـٔ]+")
        self.known: dict[str, str] = {}

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.rules:
            return text
        return self.stretches.sub(self._stretch, text)

    def _stretch(self, m: re.Match) -> str:
        old = m[0]
        if (new := self.known.get(old)) is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            new = self.known[old] = self._rewritten(old)
        return new

    def _rewritten(self, text: str) -> str:
        after = -1
        while True:
            rule, spans = self._first(text, after)
            if rule is None:
                return text
            new, out, at = self.rules[rule][1], [], 0
            for a, b in spans:
                out += [text[at:a], new]
                at = b
            text, after = "".join([*out, text[at:]]), rule

    def _first(self, text: str, after: int) -> tuple[int | None, list[tuple[int, int]]]:
        """The first rule behind ``after`` that occurs, and where, without overlaps."""
        own = one_spelling(text)
        places = _places(text) if len(own) < len(text) else None
        best, spans = None, []
        for last, rules in self.trie.iter(own):
            rule = next((k for k in rules if k > after), None)
            if rule is None or best is not None and rule > best:
                continue
            end = last + 1
            start = end - len(one_spelling(self.rules[rule][0]))
            if start and _WORD_CHAR.match(own[start - 1]) or end < len(own) and _WORD_CHAR.match(own[end]):
                continue
            if rule != best:
                best, spans = rule, []
            if not spans or start >= spans[-1][1]:
                spans.append((start, end))
        return best, spans if places is None else [(places[a], places[b]) for a, b in spans]


def one_spelling(text: str) -> str:
    """Both spellings of hamza on ya as one letter."""
    return text.replace(HAMZA_PAIR, HAMZA_LETTER)


def _places(text: str) -> list[int]:
    """Where each character of ``one_spelling(text)`` stands in ``text``, and its end."""
    out, i = [], 0
    while i < len(text):
        out.append(i)
        i += 2 if text.startswith(HAMZA_PAIR, i) else 1
    return [*out, len(text)]


def with_texts(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], str | None]]) -> DataFrame:
    """``df`` with a column's texts made anew, one by one; ``make`` gives a task its function."""
    at, names = df.columns.index(column), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            cols = batch.columns
            cols[at] = pa.array([fn(t.as_py()) for t in cols[at]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)


_REWRITERS: dict[int, Rewriter] = {}


def rewritten(pages: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with ``rules`` (misspelled_word, corrected_word) applied to their texts; a null text stays null.

    Rules without a word or a correction do nothing. The table of rules goes to every worker: it may have ``MOST_RULES`` rows.
    """
    known = rules.where("misspelled_word <> '' AND corrected_word IS NOT NULL").select("misspelled_word", "corrected_word")
    found = [tuple(r) for r in known.groupBy("misspelled_word").agg(F.min("corrected_word")).limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(found)

    def make() -> Rewriter:
        own = shared.value
        if id(own) not in _REWRITERS:
            _REWRITERS.clear()
            _REWRITERS[id(own)] = Rewriter(own)
        return _REWRITERS[id(own)]

    return with_texts(pages, text, make)


def spliced(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """``text`` with edits (start, end, new), sorted, made in one sweep; and the numbers of those that are not made.

    An edit is not made if it begins before the end of the last one made, ends before it begins, or lies outside the text.
    """
    out, left, at = [], [], 0
    for k, (start, end, new) in enumerate(edits):
        if start < at or end < start or end > len(text):
            left.append(k)
            continue
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), left


def edited(pages: DataFrame, edits: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``pages`` with ``edits`` (page_id, start, end, new) made: all columns, n_edits and overlaps.

    ``n_edits`` counts edits made, ``overlaps`` lists those that are not (array of start, end, new): an edit that overlaps one
    before it (by start, end and new), or lies outside the text. Equal edits are one. Edits without offsets are skipped; an
    edit without a text deletes. A null text is an empty one if it has edits. Time grows with a page's text and edits.
    """
    span = "array<struct<start:int,end:int,new:string>>"
    of = edits.where("start IS NOT NULL AND end IS NOT NULL").select(F.col("page_id").alias("of_page"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("new", F.lit("")).alias("new")).alias("edit"))
    of = of.groupBy("of_page").agg(F.sort_array(F.collect_set("edit")).alias("edits"))
    # The text goes once, beside the other columns.
    rows = pages.select(F.struct(*[c for c in pages.columns if c != text]).alias("row"), F.col(text).alias("text"), F.col(key).alias("key"))
    both = rows.join(of, F.col("key") == F.col("of_page"), "left").select("row", "text", "edits")
    made = T.StructType([both.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_edits", T.IntegerType()), T.StructField("overlaps", T._parse_datatype_string(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        for batch in batches:
            texts, counts, overlaps = [], [], []
            for t, own in zip(batch.column(1), batch.column(2), strict=True):
                own = own.as_py()
                if not own:
                    texts.append(t.as_py()), counts.append(0), overlaps.append([])
                    continue
                new, left = spliced(t.as_py() or "", [(e["start"], e["end"], e["new"]) for e in own])
                texts.append(new), counts.append(len(own) - len(left)), overlaps.append([own[k] for k in left])
            cols = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(overlaps, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "n_edits", "overlaps"])

    out = both.mapInArrow(run, made)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns], "n_edits", "overlaps")
