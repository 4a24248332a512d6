"""String functions of the library: script normalisation, cleaning, contents pages, markdown, citations, formats.

Native column expressions wherever Spark has them; the few that need Python run over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of the script normalisation.
PRESENTATION_FORMS = ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
HAMZA_PAIR, HAMZA_LETTER = "\u064a\u0654", "\u0626"
DROPPED = "\u200c\u200d\u200b\u0640"
CONTENTS_WORD = "مۇندەرىجە"
SENTENCE_ENDS = ".؟!:؛»\"”)]}﴾﴿…"
LIST_MARKS = "-—–*•"
LEADERS = ".·•∙⋅․﹒｡"

_FORMS = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PRESENTATION_FORMS) + "]"
_FORM = re.compile(_FORMS)
#: Texts that are Python strings at a time.
_TEXTS = 128
_DROP = str.maketrans("", "", DROPPED)


def normalized(text: str | None) -> str:
    """Presentation forms in full letters, one spelling of hamza on ya, no joiners, zero-width spaces or kashidas."""
    if not text:
        return ""
    text = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return text.replace(HAMZA_PAIR, HAMZA_LETTER).translate(_DROP)


def text_column(fn, kind: str = "string"):
    """A function of one text as a function of a column, over Arrow batches, of which ``_TEXTS`` texts are Python's at a time."""

    def column(c: Column) -> Column:
        to = to_arrow_type(T._parse_datatype_string(kind))

        def batch(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([fn(t.as_py()) for t in texts.slice(at, _TEXTS)], to) for at in range(0, len(texts), _TEXTS)] or [pa.array([], to)])

        return F.arrow_udf(batch, kind)(c)

    return column


_normalized_slow = text_column(normalized)


def normalize(c: Column) -> Column:
    """``normalized`` as a column: native unless a presentation form occurs, which only Unicode tables can expand."""
    plain = F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit(HAMZA_PAIR), F.lit(HAMZA_LETTER)), DROPPED, "")
    return F.when(F.coalesce(c.rlike(_FORMS), F.lit(False)), _normalized_slow(c)).otherwise(plain)


def match_form(c: Column) -> Column:
    """For matching only: the letters U+06D0, U+0649 and U+064A as U+06CC."""
    return F.translate(c, "\u06d0\u0649\u064a", "\u06cc\u06cc\u06cc")


# Marks of headers and footers, words broken at line ends, runs of leaders.
_MARKER = re.compile(r"\s*\[(?:header|footer)\]", re.I)
_HYPHEN_ENDS = tuple((re.compile(p), r) for p, r in ((r"(\w)[-—–_]\s*\n\s*(\w)", r"\1\2"), (r"(\w)[-—–_]\s*\n\s*", r"\1"), ("\u0640+\\s*\\n\\s*", "")))
_BLANK = re.compile(r"\n\s*\n")
_ENDS = re.compile(f"[{re.escape(SENTENCE_ENDS)}]\\s*$")
_ITEM = re.compile(r"(?:[-—–*•]|\d+[.)])\s+")
_LEADER_RUN = re.compile(f"(?:[{re.escape(LEADERS)}]\\s*){{3,}}|…{{2,}}")


def _stands_alone(line: str, following: str) -> bool:
    """Whether a line break after ``line`` means something."""
    own, after = line.lstrip(), following.lstrip()
    numbered = after[:1].isdigit() and after[1:2] in (".", " ", ")") and len(after) > 1
    return bool(_ENDS.search(line) or _ITEM.match(own) or own.startswith(("[Header]", "[Footer]", "#", "|")) or _LEADER_RUN.search(line) or after[:1] in LIST_MARKS or numbered)


def cleaned(text: str | None) -> str:
    """Recognised text in paragraphs: no page markers, words whole again, running lines joined, lists and tables as they are."""
    lines = [x for x in normalized(text).splitlines() if not _MARKER.match(x)]
    text = reduce(lambda t, step: step[0].sub(step[1], t), _HYPHEN_ENDS, "\n".join(lines))
    paragraphs = []
    for block in _BLANK.split(text):
        rows = [x.rstrip() for x in block.split("\n") if x.strip()]
        if rows:
            joints = ["\n" if _stands_alone(a, b) else " " for a, b in zip(rows, rows[1:], strict=False)]
            paragraphs.append("".join(x for pair in zip(rows, [*joints, ""], strict=True) for x in pair))
    return "\n\n".join(paragraphs)


clean = text_column(cleaned)


def is_contents_page(c: Column) -> Column:
    """Whether a page is a table of contents: the word itself, a table of page numbers, or dot leaders with page numbers.

    Native: lines are an array, every rule a fold over it.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    count = lambda cond: F.size(F.filter(lines, cond))
    n = F.size(lines)
    leader = lambda x: x.rlike(r"\.{6,}|_{6,}|-{6,}|·{6,}")
    edge = lambda x: x.rlike(r"(?U)^\d+|\d+$")
    tables = count(lambda x: x.rlike(r"(?U)^\|.*\|\s*\d+\s*\|?$"))
    dotted = count(lambda x: leader(x) & edge(x))
    numbers = F.transform(F.filter(lines, edge), lambda x: F.regexp_extract(x, r"(?U)^\d+|\d+$", 0).cast("decimal(38,0)"))
    # Adjacent pairs that don't fall.
    steps = F.zip_with(F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: F.coalesce((b >= a).cast("int"), F.lit(0)))
    rising = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    found = (
        c.contains(CONTENTS_WORD)
        | ((tables >= 5) & (tables >= 0.5 * n))
        | ((F.size(numbers) >= 5) & (dotted >= 3) & (rising >= 0.8 * (F.size(numbers) - 1)) & (dotted >= 0.3 * n))
        | ((dotted >= 5) & (dotted >= 0.5 * n))
    )
    return F.coalesce(found, F.lit(False))


def spelling_pattern(q: str) -> str:
    """A regular expression of ``q`` that accepts both spellings of hamza on ya."""
    either = f"({HAMZA_LETTER}|{HAMZA_PAIR})"
    return either.join(re.escape(part) for part in q.replace(HAMZA_PAIR, HAMZA_LETTER).split(HAMZA_LETTER))


#: White space of Unicode and the four separators of ASCII; ``$`` and ``.`` know ``\n`` alone under the flag d.
_SPACE = r"[\s\x1c-\x1f]"
_TRIM = (rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def normalize_markdown(c: Column) -> Column:
    """One kind of line end, no blanks at line ends, at most one empty line, none at either end."""
    steps = ((r"\r\n?", "\n"), (r"(?dm)[ \t]+$", ""), (r"\n{3,}", "\n\n"), _TRIM)
    return reduce(lambda x, s: F.regexp_replace(x, *map(F.lit, s)), steps, c)


# The markdown rules in their order: headings, quotes, bullets, numbers, rules, images, links, code, bold, italics, empty lines.
MARKDOWN = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^\s*>+\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+[.)]\s+", ""),
    (r"(?m)^(-{3,}|\*{3,}|_{3,})\s*$", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(`+)([^`]+)\1", "$2"),
    (r"(\*\*|__)(.*?)\1", "$2"),
    (r"(\*|_)(.*?)\1", "$2"),
    (r"\n{3,}", "\n\n"),
)


def strip_markdown(c: Column) -> Column:
    """Plain text of markdown; line ends count as one kind, and null as empty."""
    unicode = tuple((f"(?Ud){p}".replace(r"\s", _SPACE), r) for p, r in MARKDOWN)
    steps = ((r"\r\n?", "\n"), *unicode, _TRIM)
    return reduce(lambda x, s: F.regexp_replace(x, *map(F.lit, s)), steps, F.coalesce(c, F.lit("")))


# Fixed texts of citations: the word for page, the word for source.
PAGE_WORD, SOURCE_WORD = "بەت", "مەنبە"
# The forms that citations take, nested, turned round and bare.
_NESTED = re.compile(r"\[(?P<shown>[^\]]+)\]\(\[[^\]]*\]\((?P<to>ref:[^)]+)\)\)")
_TURNED = re.compile(rf"ref:(?P<book>\d+)\]{PAGE_WORD}(?P<pages>[\d\s\u060c]+)")
_TURNED_END = re.compile(r"\s*(?:ref:|\[|\Z)")
_BARE = re.compile(r"(?<!\])\b(?P<to>ref:\w+:(?:\d+(?:,\d+)*|summary))\b(?!\))")


def fixed_citations(text: str | None) -> str | None:
    """Citations as links: nested links flat, turned-round ones the right way, bare references under the source word."""
    if not text:
        return text
    text = _NESTED.sub(r"[\g<shown>](\g<to>)", text)
    out, at = [], 0
    while m := _TURNED.search(text, at):
        # What is cited reaches to the next reference, link or the end, on the same line.
        stop = _TURNED_END.search(text, m.end())
        cited, numbers = text[m.end() : stop.start()], re.findall(r"\d+", m["pages"])
        if "\n" in cited or not numbers:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        shown = [cited.strip().lstrip("\u060c").strip()] if cited.strip() else []
        out += [text[at : m.start()], f"[{'\u060c '.join([*shown, *numbers])} {PAGE_WORD}](ref:{m['book']}:{','.join(numbers)})"]
        at = stop.start()
    return _BARE.sub(rf"[{SOURCE_WORD}](\g<to>)", "".join([*out, text[at:]]))


fix_citations = text_column(fixed_citations)


def keywords(c: Column) -> Column:
    """Words of more than two characters, without punctuation."""
    return F.filter(F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w]", "")), lambda w: F.length(w) > 2)


def clean_categories(c: Column) -> Column:
    from quillspark.operators.catalog import clean_category

    return F.filter(F.transform(c, clean_category), lambda x: x != "")


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def camel_case(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t.capitalize() for t in tail)


def renamed(df, how=snake_case):
    """A DataFrame whose column names, also inside structs, are renamed."""
    from pyspark.sql import types as T

    def of(t):
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(how(f.name), of(f.dataType), f.nullable) for f in t])
        return T.ArrayType(of(t.elementType), t.containsNull) if isinstance(t, T.ArrayType) else t

    return df.select(*[F.col(f"`{f.name}`").cast(of(f.dataType)).alias(how(f.name)) for f in df.schema])


def sample_text(c: Column, most: int) -> Column:
    """A text of at most ``most`` characters: its first 40 %, a middle 20 % and its last 40 %, where it is longer."""
    head, mid = int(most * 0.4), int(most * 0.2)
    n, gap = F.length(c), F.lit("\n\n...\n\n")
    start = F.floor(n / 2).cast("int") - int(most * 0.1)
    return F.when(n <= most, c).otherwise(F.concat(F.substring(c, 1, head), gap, F.substring(c, start + 1, F.lit(mid)), gap, F.substring(c, n - head + 1, F.lit(head))))


def title_of_file(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def cover_path(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"covers/([^/?#]+)", 1), F.lit(""))


def document_header(text: Column, book_id: Column, title: Column, author: Column, volume: Column, page: Column) -> Column:
    """``[BookID: .., Book: .., ..]`` over the text; parts that are null are left out."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    inside = F.concat_ws(", ", part("BookID", book_id), part("Book", title), part("Author", author), part("Volume", volume), part("Page", page))
    return F.concat(F.lit("["), inside, F.lit("]\n"), text)


# How a citation refers to pages of a book, or to its summary.
_LINK, _REFERENCE, _BOOK_MARK = r"\[([^\]]+)\]\(([^)]+)\)", r"ref:\w+:(?:[\d,]+|summary)", r"(?i)\s*\(?BookID:\s*[a-zA-Z0-9-]+\)?"


def citation_links(c: Column) -> Column:
    """Links ``[label](ref:book:pages)`` of a text, in order: array of struct(label, book_id, pages, is_summary).

    Pages are numbers parted by commas, other parts are left out; ``summary`` in their place refers to the book's summary.
    A reference inside another link's address counts; labels lose a book id that was written into them. Links to anything
    else are left out, and a null text has none.
    """
    labels, targets = (F.regexp_extract_all(c, F.lit(_LINK), F.lit(g)) for g in (1, 2))

    def link(label: Column, target: Column) -> Column:
        nested = F.regexp_extract(target, _REFERENCE, 0)
        whole = F.when(target.startswith("ref:") | (nested == ""), target).otherwise(nested)
        parts = F.split(whole, ":")
        pages = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
        numbers = F.filter(F.transform(F.split(pages, ","), lambda p: F.regexp_extract(p, r"^\s*(\d{1,9})", 1).try_cast("int")), lambda n: n.isNotNull())
        return F.struct(
            F.regexp_replace(label, _BOOK_MARK, "").alias("label"),
            F.when(whole.startswith("ref:"), F.get(parts, F.lit(1))).alias("book_id"),
            F.when(pages == "summary", F.array().cast("array<int>")).otherwise(numbers).alias("pages"),
            (pages == "summary").alias("is_summary"),
        )

    return F.filter(F.coalesce(F.zip_with(labels, targets, link), F.array()), lambda x: x["book_id"].isNotNull())


def token_digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def address_digest(c: Column, salt: str) -> Column:
    """16 hex digits of a salted address, by which visitors are told apart without it."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16)


def short_id(c: Column) -> Column:
    """12 hex digits of a content's digest."""
    return F.substring(F.sha2(c, 256), 1, 12)
