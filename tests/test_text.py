"""Golden cases of string functions, chunking and spelling."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking as K
from quillspark.functions import spelling as S
from quillspark.functions import text as T


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


NORMALIZED = [("ﮊ", "ژ"), ("u‌yghur‍​ـ", "uyghur"), ("ئ", "ئ"), ("", ""), (None, ""), ("plain", "plain"), ("ﻻ", "لا")]


def test_normalize(spark):
    assert [T.normalized(a) for a, _ in NORMALIZED] == [b for _, b in NORMALIZED]
    assert column(spark, [a for a, _ in NORMALIZED], T.normalize) == [b for _, b in NORMALIZED]


def test_clean():
    assert "بۇ كىتاب" in T.cleaned("بۇ كىت-\nاب")
    assert T.cleaned("P1 line 1\nP1 line 2\n\nP2") == "P1 line 1 P1 line 2\n\nP2"
    assert T.cleaned("- item 1\n- item 2") == "- item 1\n- item 2"
    assert T.cleaned("[Header] gone\nOne ends.\nTwo\n  goes on") == "One ends.\nTwo   goes on"
    assert T.cleaned(None) == T.cleaned("") == ""


def test_contents_pages(spark):
    leaders = "\n".join(f"Part ........ {n}" for n in (3, 9, 12, 20, 31))
    tables = "\n".join(f"| Part | {n} |" for n in range(1, 7))
    values = [leaders, tables, "x مۇندەرىجە y", "1. one\n2. two\n3. three\n4. four\n5. five", "plain", "", None, "a ........ 9\nb ........ 8\nc ........ 7\n1\n2"]
    assert column(spark, values, T.is_contents_page) == [True, True, True, False, False, False, False, False]


def test_spelling_pattern():
    either = "(ئ|ئ)"
    assert T.spelling_pattern("ئ") == T.spelling_pattern("ئ") == either
    assert T.spelling_pattern("a.b") == r"a\.b"


def test_markdown(spark):
    assert column(spark, ["Line 1\r\nLine 2\rLine 3  \n\n\nLine 4"], T.normalize_markdown) == ["Line 1\nLine 2\nLine 3\n\nLine 4"]
    marked = ["# Title", "> quote", "- one\n* two", "1. one\n2) two", "---", "![alt](u.png)", "[text](http://x)", "`code`", "**bold** and _it_", "a\n\n\n\nb", None]
    plain = ["Title", "quote", "one\ntwo", "one\ntwo", "", "alt", "text", "code", "bold and it", "a\n\nb", ""]
    assert column(spark, marked, T.strip_markdown) == plain


CITATIONS = [
    ("[بەت14]([مەنبە](ref:book123:14))", "[بەت14](ref:book123:14)"),
    ("ref:26]بەت179 تارىخى نۇرى", "[تارىخى نۇرى، 179 بەت](ref:26:179)"),
    ("See ref:26:178,179 for details", "See [مەنبە](ref:26:178,179) for details"),
    ("ref:7:summary", "[مەنبە](ref:7:summary)"),
    ("[x](ref:1:2)", "[x](ref:1:2)"),
    ("", ""),
]


@pytest.mark.parametrize("given,fixed", CITATIONS)
def test_citations(given, fixed):
    assert T.fixed_citations(given) == fixed


def test_small_formats(spark):
    assert column(spark, ["a/b/Vol. 1.pdf"], T.title_of_file) == ["Vol. 1"]
    assert column(spark, ["https://x/covers/c.jpg?v=1", "none"], T.cover_path) == ["c.jpg", None]
    head = spark.range(1).select(T.document_header(F.lit("Content"), F.lit("b1"), F.lit("Title"), F.lit("Author"), F.lit(1), F.lit(10))).first()[0]
    assert head == "[BookID: b1, Book: Title, Author: Author, Volume: 1, Page: 10]\nContent"
    assert T.snake_case("bookId") == "book_id" and T.camel_case("book_id") == "bookId"
    df = spark.sql("SELECT 1 AS bookId, named_struct('pageNumber', 2) AS innerPart")
    assert T.renamed(df).schema.simpleString() == "struct<book_id:int,inner_part:struct<page_number:int>>"
    assert spark.range(1).select(T.clean_categories(F.array(F.lit(' "a" '), F.lit(" "), F.lit("b")))).first()[0] == ["a", "b"]
    long = "x" * 40 + "y" * 20 + "z" * 41
    assert column(spark, [long, "short"], lambda c: T.sample_text(c, 10)) == ["xxxx\n\n...\n\nyy\n\n...\n\nzzzz", "short"]


def test_chunks():
    assert K.chunks("a b c d e f", 10, 0, (" ",)) == ["a b c d e", "f"]
    assert K.chunks("This is a test with overlap", 20, 10, (" ",)) == ["This is a test with", "test with overlap"]
    assert K.chunks("") == K.chunks(None) == []
    assert K.chunks("x" * 25, 10, 0, (" ",)) == ["x" * 10]


def restated(text, size, overlap, separators):
    """The splitter once more, with running totals."""

    def merged(parts, by):
        out, held, total = [], [], 0
        for part in parts:
            if held and total + len(part) + len(by) > size:
                out.append(by.join(held))
                while total > overlap or total + len(part) + (len(by) if held else 0) > size and total > 0:
                    total -= len(held.pop(0)) + (len(by) if held else 0)
            held.append(part)
            total += len(part) + (len(by) if len(held) > 1 else 0)
        return [c for c in [*out, by.join(held)] if c]

    k = next(i for i, s in enumerate(separators) if s in text or i == len(separators) - 1)
    out, run = [], []
    for part in text.split(separators[k]) if separators[k] else list(text):
        if len(part) < size:
            run.append(part)
        else:
            out += merged(run, separators[k]) if run else []
            out += restated(part, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [part[:size]]
            run = []
    return out + (merged(run, separators[k]) if run else [])


def test_chunks_as_restated():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["ab", "cde", " ", "\n", ". ", "\n\n", "f" * 30]) for _ in range(rng.randrange(120)))
        assert K.chunks(text, 40, 10) == (restated(text, 40, 10, K.SEPARATORS) if text else [])


def test_tokens_have_raw_offsets():
    text = "abc خاتا ٠٠ كـتاب‌!"
    found = list(S.tokens(text))
    assert [word for word, *_ in found] == ["خاتا", "كتاب"]
    assert all(text[start:end] == raw for _, raw, start, end in found)


def test_variants(spark):
    assert "ڭ" in column(spark, ["ك"], S.replaced)[0]
    assert len(column(spark, ["بتث"], S.inserted)[0]) == 36

    def slow(word):
        one = []
        for a, b in S.CONFUSED:
            one += [word[:i] + b + word[i + 1 :] for i, c in enumerate(word) if c == a]
        return list(dict.fromkeys(v for v in one if v != word))

    for word in ("كونر", "قق", "ب"):
        want = slow(word)
        want = list(dict.fromkeys(want + [w for v in want for w in slow(v) if w != word]))
        assert column(spark, [word], S.replaced)[0] == want


def test_spell_check(spark):
    wrong, right, unknown, known = "خاتا", "توغرا", "كتابب", "ڭتابب"
    pages = spark.createDataFrame([(1, f"{wrong} {unknown} {unknown}", "idle"), (2, None, "idle")], "id long, text string, spell_check_milestone string")
    dictionary = spark.createDataFrame([(right,), (known,)], "word string")
    done, issues = S.check_pages(pages, dictionary, [(wrong, right)])
    assert done.orderBy("id").first()["text"].startswith(right)
    rows = issues.orderBy("char_offset").collect()
    assert [(r["word"], r["ocr_corrections"]) for r in rows] == [(unknown, [known])] * 2
    assert rows[0]["char_end"] - rows[0]["char_offset"] == len(unknown)


def test_words_found_in_pieces(spark, monkeypatch):
    """Words of whole batches are those of one text after the other, also where texts are cut."""
    import random

    rng = random.Random(4)
    letters = "ابتكئي\u0654\u0640\u200c\u200dﻻﺎ،؛ a1\n\U0001f600é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(400)] + [None, "", "ككككك", "ك" * 3, "\u064a\u0654" * 3]
    pages = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    want = sorted((i, *t) for i, text in enumerate(texts) for t in S.tokens(text))
    assert sorted(map(tuple, S.token_rows(pages).collect())) == want and len(want) > 500
    assert {r["word"] for r in S.word_rows(pages).collect()} == {w[1] for w in want}
    only = spark.createDataFrame([(w[1],) for w in want[:50]], "word string")
    assert sorted(map(tuple, S.token_rows(pages, only=only).collect())) == [w for w in want if w[1] in {x[1] for x in want[:50]}]
    monkeypatch.setattr(S, "_CHARS", 30)
    pieces = [(p, a, t) for some in S._pieces(__import__("pyarrow").array(texts)) for p, a, t in some]
    assert len(pieces) > 800 and all("".join(t for q, _, t in pieces if q == p) == (text or "") for p, text in enumerate(texts))
    got = [(p, w, r, a, b) for some in S._pieces(__import__("pyarrow").array(texts)) for p, w, r, a, b in zip(*(c.tolist() if hasattr(c, "tolist") else c.to_pylist() for c in S._token_arrays(some)), strict=True)]
    assert sorted(got) == want


def test_pages_send_on_only_words_with_corrections(spark, monkeypatch):
    """No row for each of a corpus's words: tokens are asked for by the words found to have corrections."""
    asked = []
    own = S.token_rows
    monkeypatch.setattr(S, "token_rows", lambda *a, only=None, **b: asked.append(only) or own(*a, only=only, **b))
    pages = spark.createDataFrame([(1, "كتابب توغرا بىرنەرسە")], "id long, text string")
    dictionary = spark.createDataFrame([("توغرا",), ("ڭتابب",)], "word string")
    assert [r["word"] for r in S.check_pages(pages, dictionary, [])[1].collect()] == ["كتابب"]
    assert [r["word"] for r in asked[0].collect()] == ["كتابب"]


def test_edits_from_last_to_first(spark):
    pages = spark.createDataFrame([(1, "This is a test with word1 and word2."), (2, "same")], "id long, text string")
    edits = spark.createDataFrame([(1, 20, 25, "W1"), (1, 30, 35, "W2"), (1, None, None, "no")], "page_id long, start int, end int, new string")
    rows = {r["id"]: r for r in S.apply_edits(pages, edits).collect()}
    assert (rows[1]["text"], rows[1]["n_edits"], rows[2]["text"]) == ("This is a test with W1 and W2.", 2, "same")


def test_spell_check_query_uses_confused_letters(spark):
    """Issues by page against brute force, with corrections that take one and two confused letters."""
    from types import SimpleNamespace

    from quillspark.plans import text_queries as Q

    table = str.maketrans("abdefghiklmnorstu", "ابدەفگھىكلمنورستۇ")
    known = ["karto", "mantal"]
    texts = {1: "garto karto", 2: "gartu x garto", 3: "mntal zzzz", 4: "basalt"}
    pages = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("spell_check_milestone", F.lit("idle"))
    lib = SimpleNamespace(texts_v=pages, dictionary_v=spark.createDataFrame([(w,) for w in known], "word string"))
    words = {w.translate(table) for w in known}

    def variants(word):
        once = lambda w: {w[:i] + b + w[i + 1 :] for a, b in S.CONFUSED for i, c in enumerate(w) if c == a}
        one = once(word)
        return one | {v for o in one for v in once(o)} | {word[:i] + v + word[i:] for i in range(len(word) + 1) for v in S.VOWELS}

    want = {}
    for page, text in texts.items():
        hits = [start for word, _, start, _ in S.tokens(text.translate(table)) if word not in words and variants(word) & words]
        if hits:
            want[page] = (len(hits), min(hits))
    assert want == {1: (1, 0), 2: (2, 0), 3: (1, 0)}
    assert {r["page_id"]: (r["n"], r["first"]) for r in Q.spell_check_pages(lib).collect()} == want


def test_markdown_in_unicode(spark):
    """White space and line ends are those of Unicode and of ``\\n``."""
    rows = ["#\u00a0Title\u2028more", "\u00a0* item", "**a\u0085b** _c\u2028d_", "1.\u3000one\x1f", "\u2003text\u00a0"]
    assert column(spark, rows, T.strip_markdown) == ["Title\u2028more", "item", "a\u0085b c\u2028d", "one", "text"]
    assert column(spark, ["a \u2028 \nb\t\n\n\n\nc\x1c"], T.normalize_markdown) == ["a \u2028\nb\n\nc"]


def test_corrections_against_all_variants(spark):
    """Variants made backwards from the dictionary are those that unknown words would make, in their order."""
    import random

    rng = random.Random(9)
    letters, vowels, pairs = "abcdeo", ("a", "e", "o"), (("b", "c"), ("c", "b"), ("c", "d"), ("a", "e"))
    words = lambda n: sorted({"".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(n)})
    known = words(150)
    unknown = [w for w in words(150) if w not in known]

    def once(w):
        return [w[:i] + b + w[i + 1 :] for a, b in pairs for i, c in enumerate(w) if c == a]

    def variants(w):
        one = list(dict.fromkeys(v for v in once(w) if v != w))
        two = [v for x in one for v in once(x) if v != w]
        more = [w[:i] + v + w[i:] for i in range(len(w) + 1) for v in vowels]
        return list(dict.fromkeys([*one, *two, *more]))

    want = {w: hits for w in unknown if (hits := [v for v in variants(w) if v in known])}
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    assert {r["word"]: r["corrections"] for r in S.corrections(one(unknown), one(known), vowels, pairs).collect()} == want


def test_chunks_are_sent_on_in_bounded_batches(spark, monkeypatch):
    """Rows are those of splitting each page; the plan holds no arrays of a batch's chunks, and texts are taken a few at a time."""
    from quillspark.functions import chunking as K
    from quillspark.functions import text as X

    texts = ["word and more. " * n for n in (0, 1, 40, 700, 90)] + [None, "x" * 3000, "\n\n".join(["para " * 30] * 20)]
    rows = [("b", i, t, False) for i, t in enumerate(texts)] + [("b", 99, "word " * 300, True)]
    pages = spark.createDataFrame(rows, "book_id string, page_number int, text string, is_toc boolean")
    monkeypatch.setattr(K, "SENT", 900)
    table = K.chunk_table(pages)
    assert "posexplode" not in table._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(("b", i, k, c) for i, t in enumerate(texts) for k, c in enumerate(K.chunks(t)))
    assert sorted(map(tuple, table.collect())) == want
    monkeypatch.setattr(X, "_TEXTS", 2)
    column = X.text_column(lambda t: None if t is None else [t[:3], "y"], "array<string>")
    got = {r["page_number"]: r["c"] for r in pages.select("page_number", column(pages["text"]).alias("c")).collect()}
    assert got == {r[1]: None if r[2] is None else [r[2][:3], "y"] for r in rows}
