"""Each stage works on what its predecessor kept; decisions are compared with brute force."""

import re
import zlib

import numpy as np

from corpus_pipeline import STAGES
from tidemark.llm import bpe, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = step(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        kept[name] = (before, after)
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.score for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert set(after) == {d for d in before if scored[d] < 0.5}
    before, after = kept["quality"]
    rows = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    assert set(after) == {r.doc_id for r in quality.quality(rows).collect() if r.quality >= 0.5}
    before, after = kept["exact_dedup"]
    best = {}
    for d, t in before.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t), d))
    assert set(after) == {d for _, d in best.values()}
    before, after = kept["ngram_join"]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {d: shingles(t) for d, t in before.items()}
    part = {d: d for d in sets}
    for a in sets:
        for c in sets:
            if c < a and 5 * len(sets[a] & sets[c]) >= 4 * len(sets[a] | sets[c]) and part[a] != part[c]:
                low, high = sorted((part[a], part[c]))
                part = {d: low if p == high else p for d, p in part.items()}
    assert set(after) == {d for d, p in part.items() if d == p}
    pieces = STAGES[-1][1](spark, docs, SF).collect()
    encode, whole = bpe.encoder(bpe.file_path()), {}
    for d, t in after.items():
        whole[d] = encode.tokenizer.encode(t, add_special_tokens=False).ids + [0]
    assert sum(r.length for r in pieces) == sum(map(len, whole.values())) and {r.doc_id for r in pieces} == set(after)
    assert all(r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    assert all(r.offset + r.length <= 1024 and r.doc_tokens == len(whole[r.doc_id]) for r in pieces)
