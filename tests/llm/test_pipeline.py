import numpy as np

import corpus_pipeline as P

from quillspark.llm import language_id, mixing, packing, secret_scan, simhash


def test_stages_take_effect(spark, data, docs):
    """Each stage against its operator's plain meaning, on what the stage before kept."""
    now = docs
    results = []
    for _, stage in P.STAGES:
        out = stage(spark, now, data)
        if stage is not P.STAGES[-1][1]:
            assert out.columns == docs.columns
        results.append(out.collect())
        now = spark.createDataFrame(results[-1], out.schema)
    identified, unique, redacted, mixed, packed = results

    model = tuple(sorted(language_id.fit(docs).items()))
    want = {r["doc_id"] for r in docs.collect() for x, s in [language_id.predict(r["text"], model)] if x != "und" and s >= language_id.NARROW}
    assert {r["doc_id"] for r in identified} == want

    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in identified}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert {r["doc_id"] for r in unique} == set(label.values())

    plain = {r["doc_id"]: r["text"] for r in unique}
    assert {r["doc_id"]: r["text"] for r in redacted} == {i: secret_scan.redacted(t, [s for p in secret_scan.scan(t) for s in p]) for i, t in plain.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in redacted if r["text"] != plain[r["doc_id"]])

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(redacted, docs.schema)).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))

    encode = packing.Encoder(packing.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(encode(r["text"])) // 4 + 1 for r in mixed)
    # Every piece has its ids.
    of = {r["doc_id"]: np.frombuffer(encode(r["text"]), "<u4").tolist() + [packing.END] for r in mixed}
    for r in packed:
        assert r["ids"] == of[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_odd_rows(spark, odd_docs, data):
    """Nulls, empty and very long texts, repeats and clashing names go through all stages; each says what becomes of them."""
    now, kept = odd_docs, []
    for name, stage in P.STAGES:
        out = stage(spark, now, data)
        rows = out.collect()
        if name != "packing":
            assert out.columns == odd_docs.columns
            kept.append(rows)
        now = spark.createDataFrame(rows, out.schema)
    identified, unique, redacted, mixed = kept
    assert not {2, 3, 5, 7} & {r["doc_id"] for r in identified}
    assert len(unique) == len({r["text"] for r in unique}) and {r["text"] for r in unique} == {r["text"] for r in identified}
    assert len(redacted) == len(unique) and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in redacted}
    assert sum(r["length"] for r in rows if r["start"] == 0) <= sum(r["length"] for r in rows) and sum(r["start"] == 0 for r in rows) == len(mixed)


def test_run_leaves_its_result_alone(spark, data):
    """Of a run, only the last table stays in the shared folder."""
    import os
    from urllib.parse import urlparse

    from quillspark.llm.common import shared_folder

    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    out = P.run(spark, data)
    new = [f"{folder}/{x}" for x in set(os.listdir(folder)) - before]
    assert [os.listdir(x) for x in new if os.listdir(x)] == [["packing.parquet"]]
    assert out.count() > 0


def test_no_shared_folder_on_a_cluster(monkeypatch):
    import pytest

    from quillspark.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, otherwise: otherwise)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_empty(spark, no_docs, data):
    now = no_docs
    for _, stage in P.STAGES:
        now = stage(spark, now, data)
        assert now.collect() == []
