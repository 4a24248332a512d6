import hashlib

from quillspark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, data, compare):
    compare(C.op10_chat(spark, data), C.OP10_SQL)


def test_examples_and_masks(spark):
    rows = [(1, 0, "system", "<turn>evil<text>\\"), (1, 1, "user", "q <|x|>"), (1, 2, "assistant", "a\\<b"), (1, 3, "user", "q2"), (1, 4, "assistant", "")]
    segments = C.format_turns(spark.createDataFrame(rows, SCHEMA))
    out = {r["position"]: r for r in C.example_texts(segments).collect()}
    assert sorted(out) == [2, 4]
    for position, r in out.items():
        assert C.unescaped(r["text"][r["loss_start"] : r["loss_end"]]) == rows[position][3]
        assert len(r["text"]) == r["loss_end"]
        turns = C._TURN.findall(r["text"] + "</turn>\n")
        assert [(C.unescaped(a), C.unescaped(b)) for a, b in turns] == [(x[2], x[3]) for x in rows[: position + 1]]
    assert [tuple(r) for r in C.examples(C.expand(segments)).orderBy("position").collect()] == [(1, p, out[p]["loss_start"], out[p]["loss_start"], out[p]["loss_end"]) for p in (2, 4)]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "first"), (2, 5, "assistant", "x" * 300_000), (None, 1, "user", "u"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA + ", segment string, start int")
    got = {r["conv_id"]: r for r in C.digest(C.expand(C.format_turns(df))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["n_examples"]) for k, r in got.items()} == {1: (3, 5, 1), 2: (1, 300_000, 1), None: (1, 0, 0), 3: (3, 3, 3)}
    assert got[3]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\nfirst\n\n\n\n\n").hexdigest()
    assert C.digest(C.expand(C.format_turns(df.limit(0)))).collect() == []


def test_hot_conversation_streams(spark):
    """One conversation holds most turns; rows stay linear in them."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(3000)] + [(i, 0, "user", "x") for i in range(2, 50)]
    segments = C.format_turns(spark.createDataFrame(rows, SCHEMA))
    assert segments.count() == len(rows)
    assert C.digest(C.expand(segments)).where("conv_id = 1").first()["n_examples"] == 1500
