import random
import re
import time

from quillspark.functions import rewriting as R
from quillspark.functions import spelling as S
from quillspark.functions.text import spelling_pattern
from quillspark.operators import jobs as J


def fold(text, rules):
    """One regular expression a rule, one after the other."""
    least = {}
    for word, new in rules:
        least[word] = min(new, least.get(word, new))
    for word, new in sorted(least.items(), key=lambda r: (-len(r[0]), r[0])):
        if word:
            text = re.sub(f"(?<![{S.WORD_CHARS}]){spelling_pattern(word)}(?![{S.WORD_CHARS}])", lambda m, new=new: new, text)
    return text


def test_rules_are_the_fold():
    """Words with spaces, Latin letters, both spellings of hamza, kashidas; rules that rewrite what others wrote."""
    rng = random.Random(2)
    changed = 0
    for _ in range(8000):
        word = lambda n: "".join(rng.choice("ابئئae -.ـ") for _ in range(rng.randint(0, n)))
        rules = [(word(4), word(4)) for _ in range(rng.randint(0, 6))]
        text = word(24)
        if rules and rng.random() < 0.7:
            text = " ".join(rng.choice([text[:5], rng.choice(rules)[0]]) for _ in range(6))
        got = R.Rewriter(rules)(text)
        assert got == fold(text, rules), (text, rules)
        changed += got != text
    assert changed > 3000


def test_a_correction_is_corrected_by_a_later_rule():
    assert R.Rewriter([("ابتث", "كك"), ("كك", "ل"), ("ل", "م")])("ابتث ابتثا") == "م ابتثا"
    assert R.Rewriter([("ك", "ابت"), ("ابت", "ل")])("ك") == "ابت"


def test_rules_of_a_table(spark):
    rules = spark.createDataFrame([("خاتا", "توغرا"), ("", "x"), ("كك", None), (None, "ل"), ("خاتا", "ۇ")], "misspelled_word string, corrected_word string")
    pages = spark.createDataFrame([(1, "خاتا كك خاتاا", 7), (2, None, 8), (3, "", 9)], "id long, text string, row int")
    assert [tuple(r) for r in R.rewritten(pages, rules).orderBy("id").collect()] == [(1, "توغرا كك خاتاا", 7), (2, None, 8), (3, "", 9)]
    assert [tuple(r) for r in R.rewritten(pages, rules.limit(0)).orderBy("id").collect()] == [tuple(r) for r in pages.collect()]
    done, _ = S.check_pages(pages.withColumn("spell_check_milestone", pages["text"]), spark.createDataFrame([("توغرا",)], "word string"), rules)
    assert done.where("id = 1").first()["text"].startswith("توغرا ")


def test_time_does_not_grow_with_rules():
    rng = random.Random(3)
    words = ["".join(rng.choice("ابتثجحخدرز") for _ in range(rng.randint(4, 9))) for _ in range(101_000)]
    text = " ".join(words[:20_000])

    def took(rules):
        rewrite = R.Rewriter([(w, w + "ۇۇ") for w in rules])
        began = time.perf_counter()
        rewrite(text)
        return time.perf_counter() - began

    few, many = took(words[:100]), took(words[:100_000])
    assert many < 20 * few + 1.5


def slow_edits(text, edits):
    """Edits in order, each against what those before it left, all in places of the first text."""
    made, last, left = [], 0, []
    for e in sorted(set(edits)):
        if last <= e[0] <= e[1] <= len(text):
            made.append(e)
            last = e[1]
        else:
            left.append(e)
    for a, b, new in reversed(made):
        text = text[:a] + new + text[b:]
    return text, len(made), left


def test_edits_are_spliced_and_overlaps_reported(spark):
    rng = random.Random(4)
    pages, edits, want = [], [], {}
    for i in range(200):
        text = "".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 40)))
        own = [(a := rng.randint(-1, 42), a + rng.randint(-1, 6), rng.choice(["", "X", "yy"])) for _ in range(rng.randint(0, 8))]
        pages.append((i, text, "row"))
        edits += [(i, *e) for e in own + own[:1]]
        want[i] = slow_edits(text, own)
    edits += [(0, None, 3, "no"), (0, 3, None, "no"), (999, 0, 1, "nobody")]
    found = R.edited(spark.createDataFrame(pages, "id long, text string, edits string"), spark.createDataFrame(edits, "page_id long, start int, end int, new string"))
    assert found.columns == ["id", "text", "edits", "n_edits", "overlaps"]
    for r in found.collect():
        assert (r["text"], r["n_edits"], [tuple(e) for e in r["overlaps"]]) == want[r["id"]] and r["edits"] == "row"


def test_edits_of_pages_without_text(spark):
    pages = spark.createDataFrame([(1, None), (2, None), (None, "x")], "id long, text string")
    edits = spark.createDataFrame([(1, 0, 0, "new"), (1, 0, 0, None), (None, 0, 1, "y")], "page_id long, start int, end int, new string")
    assert {r["id"]: (r["text"], r["n_edits"]) for r in R.edited(pages, edits).collect()} == {1: ("new", 2), 2: (None, 0), None: ("x", 0)}


def test_many_edits_of_one_page_take_linear_time():
    def took(n):
        text, edits = "word " * n, [(5 * i, 5 * i + 4, "longer") for i in range(n)]
        began = time.perf_counter()
        new, left = R.spliced(text, edits)
        assert new == "longer " * n and not left
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 60 * took(10_000) + 0.5


def test_issues_that_overlap_stay_open(spark):
    pages = spark.createDataFrame([(1, "teh cat", "succeeded", "succeeded")], "id long, text string, chunking_milestone string, embedding_milestone string")
    issues = spark.createDataFrame([(1, 1, "teh", 0, 3, "open"), (2, 1, "eh", 1, 3, "open"), (3, 1, "cat", 4, 7, "open")], "id long, page_id long, word string, char_offset int, char_end int, status string")
    rules = spark.createDataFrame([("teh", "the", True), ("eh", "he", True), ("cat", "dog", True)], "misspelled_word string, corrected_word string, is_active boolean")
    new, after = J.corrected_pages(pages, issues, rules)
    assert new.first()["text"] == "the dog"
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "corrected", 2: "open", 3: "corrected"}


def test_texts_go_to_their_edits_once(spark):
    pages = spark.createDataFrame([(1, "one two", "x")], "id long, text string, other string")
    edits = spark.createDataFrame([(1, 0, 3, "1"), (1, 0, 3, "1")], "page_id long, start int, end int, new string")
    found = R.edited(pages, edits)
    assert [tuple(r) for r in found.collect()] == [(1, "1 two", "x", 1, [])]
    sent = found._jdf.queryExecution().analyzed().toString().split("struct(", 1)[1].split(") AS row", 1)[0]
    assert sent.startswith("id, id") and "text, text" not in sent
