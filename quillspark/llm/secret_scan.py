"""Secret scans by dictionary-primed zstandard novelty.

Fixed patterns give the base spans. Beyond these, strings that structure or words mark as sensitive are candidates:

* values assigned to a name with a sensitive word, on its line, on the next one, or as an indented block of lines; of eight
  characters or more, with any characters but white space, quotes and brackets;
* credential-like strings behind a sensitive word in its sentence, however long it is; of eight characters or more, and no
  mere words (those lack digits beside letters and frequent changes of case);
* passwords in addresses (``scheme://user:value@host``), bodies of private keys, web tokens of three parts as a whole, and
  strings with a known prefix, wherever they stand.

A candidate's marginal compressed bytes are measured, whatever its length, against a zstandard raw-content dictionary and the
surrounding text, its name included; a string that neither explains is reported as ``novel``. The dictionary holds the
identifiers of code and configuration listed here and the most frequent identifiers of the documents themselves, counted over
all of them. What base spans leave of a candidate is measured in the same way; of candidates that overlap the one that begins
first counts, then the longest.

Null texts count as empty. Every text is scanned whole, in time about its length. Rows are independent of one another but for
the dictionary: ties, repeated rows and empty tables need no care, and columns other than ``doc_id`` and ``text`` are not read
(``redact`` passes them on untouched).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Lower-case literals of which ASSIGN needs one, and of which a sensitive context needs one.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|auth[_ -]?key|client[_ -]?key|signing[_ -]?key|encryption[_ -]?key)", re.I | re.A)
SENSITIVE_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
#: A candidate may begin behind any separator, '=' included; '=' itself stands only as padding at its end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{6,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: A name behind its sensitive word, and its separator; then what is assigned to it, or the head of a block of lines.
ASSIGNED = re.compile(r"""[\w.-]{0,64}+["'\])]{0,8}+\s*+(?::=|=>|[:=])[ \t]*+(?:[|>][+-]?[ \t]*+(?=\n))?+\s*+["'`]?""", re.A)
VALUE = re.compile(r"""[^\s"'`<>()\[\]{},;&]{8,}""")
BLOCK_HEAD = re.compile(r"[|>][+-]?[ \t]*\n\s*$")
NEXT_LINE = re.compile(r"\n[ \t]+(?=\S)")
#: What ends a sentence: its mark before white space, or the line.
SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*(?=\s)|\n")
#: Strings that are secrets wherever they stand, by their form: the part that is measured is in a group.
FORMS = (
    re.compile(r"[a-z][a-z0-9+.-]{0,30}://[^\s/@:]{0,64}:([^\s/@]{6,256})@", re.I),
    re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----\s*([^-]{16,}?)\s*(?=-----END|\Z)"),
    re.compile(r"(?<![A-Za-z0-9+/_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)"),
    re.compile(r"(?<![A-Za-z0-9])((?:[spr]k_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|SG\.|AIza)[A-Za-z0-9_.-]{12,})"),
)
#: Literals of which each form needs one.
FORM_WORDS = ("://", "PRIVATE KEY-----", "eyJ", ("_live_", "_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "SG.", "AIza"))
#: Least length of a candidate.
LEAST_NOVEL = 8
#: Code points of surrounding text on either side that prime the compressor.
AROUND = 256
#: Marginal compressed bytes for each byte of the string from which it counts as incompressible.
NOVELTY = 0.75
#: The same for strings of less than ``SHORT`` code points, whose letters alone can be coded in less than a byte each.
SHORT, NOVELTY_SHORT = 16, 0.7
#: Identifiers taken from the documents, their least and greatest length.
LEARNED, IDENTIFIER = 2000, r"(?<![A-Za-z0-9_])[a-z]+(?:_[a-z]+)+(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[a-z]{8,24}(?![A-Za-z0-9_])"
#: Identifiers and words of code and configuration that are no secrets.
IDENTIFIERS = (
    "abstract admin algorithm alias allow api_key api_key_id application argument array assert async attribute auth authorization "
    "average backend base64 batch bearer boolean branch buffer bytes cache callback certificate charset checksum class client_id "
    "client_secret cluster column command commit component config configuration connection constant container content context "
    "controller cookie counter create_user credentials csrf_token current_user database datetime default delete description "
    "development device dictionary directory document domain download element email enable encoding encryption endpoint "
    "environment exception execute expires_in exponent export extension factory feature field filename filter format framework "
    "function gateway generate get_password_hash github global handler hash_password header hostname identifier import index "
    "information initialize input instance integer interface internal invalid_token iterator javascript key_id keyword language "
    "length library license lifecycle listener localhost location logger manager message metadata method middleware migration "
    "module namespace network next_token number object operation option organization output override package page_token parameter "
    "parse password_reset path pattern permission pipeline placeholder platform plugin pointer policy position prefix primary_key "
    "private_key process production profile project property protocol provider public_key python query random reader readme record "
    "redirect reference refresh_token register release remote replace repository request reset_token resource response result "
    "return role route runtime sample schema scheduler scope search secret_name section secure select sequence server service "
    "session_token settings signature socket source stack standard static status storage stream string structure subject "
    "success suffix summary support switch symbol system table target template test_token thread timeout timestamp "
    "tokenizer token_type tokens tracking transaction transform trigger tuple undefined unique update upload username value "
    "variable vector verify version view virtual visitor warning webhook width window worker workspace wrapper "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 123456789012345678901234567890 "
    "00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx your_api_key_here YOUR_API_KEY_HERE changeme example"
)
PRIMED = IDENTIFIERS[:400] + "\n"
_TAIL = b"\n" * 16
_NOT_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


@lru_cache(4)
def _compressor(identifiers: str):
    import zstandard

    words = zstandard.ZstdCompressionDict((identifiers + " " * 64).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(text: str, start: int, end: int, identifiers: str = IDENTIFIERS, around: int = AROUND) -> int:
    """Compressed bytes that text[start:end] adds to what surrounds it, primed by the identifiers.

    Some of these come first in what is compressed: they cost one match, and keep short texts from being stored as they are.
    """
    z = _compressor(identifiers)
    near = (PRIMED + text[end : end + around] + "\n" + text[max(0, start - around) : start]).encode("utf-8", "surrogatepass")
    # No match begins in the last bytes of what is compressed: these are no part of the string.
    return len(z.compress(near + text[start:end].encode("utf-8", "surrogatepass") + _TAIL)) - len(z.compress(near + _TAIL))


def identifiers(docs: DataFrame, most: int = LEARNED) -> str:
    """The listed identifiers, then the documents' most frequent ones: words of lower-case letters and underscores.

    Counted over all documents. Such words have neither digits nor changes of case, so no random string is among them,
    however often copies repeat it.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IDENTIFIER), 0)).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
    return " ".join([IDENTIFIERS, *(r["word"] for r in reversed(top.collect()))])


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    low = text.lower() if low is None else low
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in text.encode("utf-8", "surrogatepass").translate(_NOT_HEX):
        found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def uncovered(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches of start to end that no base span covers."""
    left = []
    for s, e in sorted((s, e) for s, e, _ in base if s < end and start < e):
        if s > start:
            left.append((start, s))
        start = max(start, e)
    return left + [(start, end)] if start < end else left


def _wordlike(value: str) -> bool:
    """Whether a string lacks both digits beside letters and the frequent changes of case of random letters.

    Short strings need frequent changes of any kind: a word with a number at its end has none.
    """
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False) if a and b)
    if len(value) < SHORT:
        return 4 * changes < len(value)
    if "d" in kinds and ("u" in kinds or "l" in kinds):
        return False
    return 5 * sum(a != b for a, b in zip(kinds, kinds[1:], strict=False) if a in ("u", "l") and b in ("u", "l")) < 2 * len(value)


def assigned_values(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Values of names with a sensitive word that ends at ``ends``; of a block of lines each line's."""
    found, at = [], 0
    for n in ends:
        if n < at or not (m := ASSIGNED.match(text, n)):
            continue
        value = VALUE.match(text, m.end())
        block = BLOCK_HEAD.search(text, m.start(), m.end()) is not None
        while value:
            found.append(value.span())
            at = value.end()
            following = NEXT_LINE.match(text, at) if block else None
            value = VALUE.match(text, following.end()) if following else None
    return found


def spoken_values(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Credential-like strings behind a sensitive word of their sentence."""
    stops = [m.end() for m in SENTENCE_END.finditer(text, ends[0])]
    found = []
    for m in CANDIDATE.finditer(text, ends[0]):
        start = m.start()
        word = ends[bisect_right(ends, start) - 1]
        stop = bisect_right(stops, start)
        if (not stop or stops[stop - 1] <= word) and m.end() - start >= LEAST_NOVEL and not _wordlike(m[0]):
            found.append(m.span())
    return found


def formed_values(text: str) -> list[tuple[int, int]]:
    """Strings that their form alone makes candidates."""
    found = []
    for form, words in zip(FORMS, FORM_WORDS, strict=True):
        if any(w in text for w in ((words,) if isinstance(words, str) else words)):
            found += [m.span(1) for m in form.finditer(text)]
    return found


def novel_spans(text: str, base: list[tuple[int, int, str]], low: str | None = None, novelty: float = NOVELTY, known: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Incompressible candidates, without what base spans cover."""
    low = text.lower() if low is None else low
    candidates = formed_values(text)
    if any(w in low for w in SENSITIVE_WORDS) and (ends := [m.end() for m in SENSITIVE.finditer(text)]):
        candidates += assigned_values(text, ends) + spoken_values(text, ends)
    starts_of_base, reach_of_base = [s for s, _, _ in base], []  # base spans by start, and how far those up to each one reach
    for _, e, _ in base:
        reach_of_base.append(max(e, reach_of_base[-1] if reach_of_base else 0))
    found: list[tuple[int, int, str]] = []
    at = 0
    for start, end in sorted(candidates, key=lambda c: (c[0], -c[1])):
        start = max(start, at)
        if end - start < LEAST_NOVEL:
            continue
        first = bisect_right(reach_of_base, start)
        for s, e in uncovered(start, end, base[first : bisect_left(starts_of_base, end)]):
            if e - s >= LEAST_NOVEL and marginal_bytes(text, s, e, known) >= (novelty if e - s >= SHORT else NOVELTY_SHORT) * (e - s):
                found.append((s, e, "novel"))
                at = e
    return found


def scan(text: str | None, known: str = IDENTIFIERS) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of a text."""
    if not text:
        return [], []
    low = text.lower()
    base = base_spans(text, low)
    return base, novel_spans(text, base, low, known=known)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """The text with each stretch of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "doc_id long, spans array<struct<start:long,end:long,kind:string,text:string>>"


def secret_spans(docs: DataFrame, known: str | None = None) -> DataFrame:
    """All spans of each document with the matched strings: doc_id, spans by start, then kind.

    ``known`` are the identifiers that prime the compressor; without them they are taken from ``docs``.
    """
    known = identifiers(docs) if known is None else known

    def run(batch: pa.RecordBatch) -> dict:
        spans = []
        for text in batch.column("text").to_pylist():
            base, more = scan(text, known)
            every = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
            spans.append([{"start": s, "end": e, "kind": k, "text": text[s:e]} for s, e, k in every])
        return {"doc_id": batch.column("doc_id"), "spans": spans}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SPANS)


def redact(docs: DataFrame, mask: str = "[secret]", known: str | None = None) -> DataFrame:
    """The documents with every secret span replaced; ``n_chars``, where there is one, follows. A null text stays null."""
    names = docs.columns
    known = identifiers(docs) if known is None else known

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            new = [t if not t else redacted(t, [s for part in scan(t, known) for s in part], mask) for t in texts]
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                i = names.index("n_chars")
                was = cols[i].to_pylist()
                cols[i] = pa.array([w if a == b else len(b) for w, a, b in zip(was, texts, new, strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    spans = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
