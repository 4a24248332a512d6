from pyspark.sql import functions as F

from quillspark.llm import language_id as L
from quillspark.llm.common import crc_mod_of


def test_held_out_accuracy(spark, data, docs):
    rows = L.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: (r["lang"], len((r["text"] or "").split())) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == (crc_mod_of(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]][1] >= 10]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) / len(held) > 0.97


def test_marks_stay_in_words():
    assert L.letters("हिन्दी में १२3_x") == "हिन्दी में x" and L.letters("A1b! C") == "a b c" and L.letters("É9é") == "é é"


def test_labels_of_held_out_rows_are_not_learned(spark, docs):
    """Held-out labels may be anything: nothing changes."""
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert L.fit(docs) == L.fit(spoiled)


def test_prediction_reads_whole_texts(docs):
    model = tuple(sorted(L.fit(docs).items()))
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 2000").collect()}
    english, german = by["en"], by["de"]
    assert L.predict(english[:500] + german * 6, model)[0] == "de"
    assert L.predict(german[:500] + english * 6, model)[0] == "en"


def test_odd_rows(spark, odd_docs, no_docs, docs):
    model = L.fit(docs)
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in L.classify(odd_docs, model).collect()}
    assert {r for r in rows if r[0] in (2, 3, 5, 7)} == {(i, "und", 0.0) for i in (2, 3, 5, 7)}
    assert L.classify(no_docs, model).collect() == []
    assert L.fit(no_docs) == {} and {r["lang_pred"] for r in L.classify(odd_docs, {}).collect()} == {"und"}
    kept = L.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {2, 3, 5, 7} & {r["doc_id"] for r in kept.collect()}
    assert L.predict("word", (("only", b"x"),)) == ("only", 1.0)
