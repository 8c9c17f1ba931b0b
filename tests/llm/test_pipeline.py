"""The corpus pipeline, stage by stage, against brute force on its own input."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from prosestat.llm import mixing, quality, tokens

from .test_operators import ODD, brute_components, brute_secrets


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    good = cp.keep_good(spark, docs, sf).cache()
    want = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert good.columns == cp.COLUMNS and {r["doc_id"] for r in good.collect()} == want
    assert all(tuple(r) == tuple(rows[r["doc_id"]][c] for c in cp.COLUMNS) for r in good.collect())

    one = cp.drop_copies(spark, good, sf).cache()
    roots = brute_components([(r["doc_id"], r["text"] or "") for r in good.collect()])
    assert {r["doc_id"] for r in one.collect()} == {i for i, r in roots.items() if i == r}

    clean = cp.hide_secrets(spark, one, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        if brute_secrets(texts[r["doc_id"]]):
            assert r["text"] != texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
            assert not any(texts[r["doc_id"]][s:e] in r["text"] for s, _, e in brute_secrets(texts[r["doc_id"]]))
    assert clean.count() == one.count()

    mixed = cp.mix_sources(spark, clean, sf).cache()
    taken = {r["doc_id"]: r for r in mixing.mix(clean).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for i, r in taken.items():
        n = copies.get(i, 0)
        assert n <= 3 and (r["size"] == 0 or abs(n - r["taken"] / r["size"]) < 1)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    digest = lambda t: (len(ids := library.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in cp.encode(spark, mixed, sf).collect())
    assert got == sorted((r["doc_id"], *digest(r["text"])) for r in mixed.collect())


def test_odd_rows_pass_all_stages(spark, sf):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        for name, stage in cp.STAGES:
            frame = stage(spark, frame, sf)
            assert name == "encoding" or frame.columns == cp.COLUMNS
        frame.collect()
