"""The pipeline's result against its stages' own rules in plain Python."""

import zlib
from array import array

import numpy as np

import corpus_pipeline
from orrery.llm import langid, pii, simhash
from orrery.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{len(frames)}")
        frames.append(spark.read.parquet(f"{tmp_path}/{len(frames)}"))
        if len(frames) < 6:
            assert frames[-1].columns == docs.columns
    rows = [f.collect() for f in frames]
    classify = langid.classifier(langid.learn(docs.filter(~langid.held_out(docs.doc_id))))
    want = {}
    for r in rows[0]:
        lang, _, margin, best = classify(r.text)
        if lang != "und" and margin >= max(langid.LEAST_BYTES, langid.NARROW * best):
            want[r.doc_id] = (lang, r.text)
    assert {r.doc_id: (r.lang, r.text) for r in rows[1]} == want
    kept = {r.doc_id for r in rows[2]}
    bits, blocks, radius = simhash.shape(len(rows[1]))
    hasher = simhash.WideHasher(5, bits * blocks)
    fps = {r.doc_id: np.frombuffer(hasher(r.text), np.uint64) for r in rows[1]}
    ids = sorted(fps)
    far = simhash.distances(np.array([fps[i] for i in ids])[:, None], np.array([fps[i] for i in ids])[None])
    at = {i: n for n, i in enumerate(ids)}
    for i in set(fps) - kept:
        assert any(far[at[i], at[j]] <= radius for j in ids if j != i)
    stay = [at[i] for i in kept]
    close = far[np.ix_(stay, stay)] <= radius // 2  # near enough to be met almost surely
    assert close.sum() == len(stay)
    assert {r.doc_id: r.text for r in rows[3]} == {r.doc_id: pii.mask(r.text) for r in rows[2]}
    assert {r.doc_id for r in rows[4]} <= kept
    tok = Tokenizer.from_file(tokenizer())
    ids = sorted((r.doc_id, len(x), zlib.crc32(array("I", x).tobytes())) for r in rows[4] for x in [tok.encode(r.text, add_special_tokens=False).ids + [1]] if len(x) <= 4096)
    whole = sorted((r.doc_id, r["length"], r.ids_crc32) for r in rows[5] if r["length"] < 4096 and r.start == 0)
    assert [x for x in ids if x[1] < 4096] == whole
