"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import functools
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, ngram_join, packing, quality, range_coder, sampling, token_files, toxicity, unigram, url_filter, vector_search

LONG = "the same words again and other words " * 400
TEXTS = [(1, "a b c d"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " end"), (7, "a  b c\nd"), (7, "a  b c\nd"), (8, "漢字 🙂 é"), (None, "a b c d"), (9, LONG)]
CLASH = "doc_id long, text string, score double, rank int, id string, _row string, n long, node long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 0.5, 1, "x", "y", 3, 4) for d, t in TEXTS], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def _written(docs, folder):
    token_files.write(docs, str(folder / "files"))
    return str(folder / "files")


def test_empty_tables(spark, none, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        exact_dedup.exact_dedup(none), exact_dedup.distinct_texts(none), ngram_join.ngram_components(none), ngram_join.one_of_each(none),
        packing.pack(none), token_files.read(spark, _written(none, tmp_path)), quality.quality(none), sampling.sample_segmentations(none), toxicity.toxicity(none, labels), unigram.token_counts(none),
        url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")),
        vector_search.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.collect() == []


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for d, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    want = collections.Counter((d, min(g)[3], len(g)) for g in groups.values() for *_, d in g)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.distinct_texts(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_salts_hot_texts(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(900)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(1, 600)}
    assert sum(r.kept for r in got) == 301


def _brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    least = {p: min((d for (d, _), q in zip(rows, part) if q == p and d is not None), default=None) for p in part}
    return sorted(((d, len(s), least[p] if s else d) for (d, _), s, p in zip(rows, sets, part)), key=str)


def test_ngram_components_against_brute_force(spark, docs):
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, n, percent).collect()), key=str)
        assert got == _brute_components(TEXTS, n, percent)


def test_ngram_components_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:40], *(f"y{x}" for x in rng.integers(0, 10**6, 110))])) for i in range(60)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == _brute_components(rows, 3, 90)

def test_ngram_components_of_copies_that_share_changes(spark):
    """Chains away from an original: many links are between copies, few with the original itself."""
    rng = np.random.default_rng(11)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(int(rng.integers(60, 160)))]
        changes = [(int(at), f"g{group}c{at}x{k}") for k, at in enumerate(rng.integers(0, len(base), 14))]
        for _ in range(70):
            w = list(base)
            for c in rng.choice(14, int(rng.integers(0, 9)), replace=False):
                w[changes[c][0]] = changes[c][1]
            rows.append((len(rows), " ".join(w[int(rng.integers(0, 4)) : len(w) - int(rng.integers(0, 9))])))
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()), key=str)
        assert got == _brute_components(rows, n, percent)


def test_ngram_pairs_of_copies_with_changes_of_their_own(spark, monkeypatch):
    """Copies that share nothing but their original, half of them too far from it: few pairs are left to verify."""
    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for at in rng.choice(150, 1 + i % 9, replace=False):
            w[int(at)] = f"x{i}x{at}"
        rows.append((i, " ".join(w)))
    staged = {}
    real = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: staged.setdefault(name, []).append(real(df, name)) or staged[name][-1])
    monkeypatch.setattr(ngram_join, "unstage", lambda df: None)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    assert got == _brute_components(rows, 5, 80)
    assert staged["join-placed"][0].count() > 300 and staged["join-rest"][0].count() < 5 * len(rows)


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for ids in (rng.integers(0, 50257, n), rng.zipf(1.4, n) % 50257, np.full(n, 50256), np.arange(n) % 300):
            block = range_coder.pack_block([None, 5], [ids[: n // 2].astype(np.uint16), ids[n // 2 :].astype(np.uint16)], 17, 50257)
            first, docs, lengths, back = range_coder.unpack_block(block)
            assert first == 17 and docs.tolist() == [range_coder.NULL_ID, 5] and lengths.tolist() == [n // 2, n - n // 2] and (back == ids).all()
    wide = rng.integers(0, 1 << 21, 3000)
    assert (range_coder.unpack_block(range_coder.pack_block([1], [wide], 0, 1 << 21))[3] == wide).all()
    for at in (0, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            range_coder.unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_words_kept_are_bounded_by_the_caller(spark):
    """The pipeline's packing keeps fewer words than packing alone; the pieces are the same."""
    few = bpe.encoder(bpe.file_path(), 20_000)
    words = [f"w{i * 7919}x, y{i}" for i in range(500)]
    many = bpe.Encoder(bpe.file_path())
    assert all(few.ids(w).tolist() == many.ids(w).tolist() for w in words) and few.held <= 20_000 and len(few) < len(many)
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    pieces = [sorted(packing.pack(docs, **how).collect()) for how in ({}, {"kept": 20_000})]
    assert pieces[0] == pieces[1] and corpus_pipeline.KEPT_BYTES < bpe.KEPT_BYTES


def test_range_coder_compresses():
    """Better than the ids' order-0 entropy, and than zlib."""
    encode = bpe.encoder(bpe.file_path())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").column("text").to_pylist()
    ids = np.concatenate([encode.ids(t) for t in texts])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * len(range_coder.pack_block([1], [ids], 0, 50257)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() - 0.5 and bits < 8 * len(zlib.compress(ids.tobytes())) / len(ids) - 1


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.file_path())
    t.encode_special_tokens = True
    return t


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe_agrees_with_the_library():
    e = bpe.encoder(bpe.file_path())
    for _, t in [*TEXTS, (0, "it's  <|endoftext|> 12ab\r\n\u2028x\u00a0y ﷽ ñ")]:
        assert e.ids(t).tolist() == _ids(t)
    rng = np.random.default_rng(0)
    for letters in (list("ab  \n\n\t\r's1.,é\xa0-\x85\x1c "), list("ab'  \n.,s "), list("a \n"), list("ab'&\x01  …€é中"), ["'s", "'ll", " ", "x", "1", "é", "!", "\n", "²", "½"]):
        for _ in range(300):
            t = "".join(rng.choice(letters, int(rng.integers(0, 14))))
            assert e.ids(t).tolist() == _ids(t), repr(t)


def test_token_files(spark, docs, tmp_path):
    token_files.write(docs, str(tmp_path / "t"), block_ids=50)
    rows = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == _crc(r.ids)
        at += r.n_tokens
    assert sorted(r.ids for r in rows) == sorted(_ids(t) for _, t in TEXTS)


def test_packing(spark, docs):
    rows = packing.pack(docs, window=64).collect()
    total = sum(len(_ids(t)) for _, t in TEXTS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == min(64, total - 64 * s)
    texts = {d: _ids(t) for d, t in TEXTS}
    assert all(r.ids_crc32 == _crc(texts[r.doc_id][r.start : r.start + r.length]) for r in rows)
    assert sum(r.length for r in rows) == total


def test_count_viterbi_agrees_with_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([(p, s) for p, s, _ in unigram.pieces(unigram.model_path())], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = np.random.default_rng(1)
    letters = list("aeth er on in ▁<0x0A>\n\tséñ漢字中🙂0123")
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(500)]
    viterbi = unigram.counter(unigram.model_path())
    for x in texts:
        assert int(viterbi.text(x).imag) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_sampling_without_replacement(spark, docs):
    lat = sampling.lattices(sampling.model_path())
    found = list(sampling.top_k(lat, np.arange(4000), ["then on"] * 4000, 3, 5))
    first = collections.Counter(tuple(f[2]) for f in found if f[1] == 1)
    p = {tuple(f[2]): np.exp(f[3]) for f in found}
    assert all(abs(first[s] / 4000 - q) < 0.03 for s, q in p.items())
    by = collections.defaultdict(list)
    for d, _, ids, logp, _, inclusion in found:
        assert lat.decode(ids) == "then on"
        by[d].append((tuple(ids), np.exp(logp - inclusion)))
    assert all(len({i for i, _ in x}) == len(x) for x in by.values())
    assert abs(np.mean([sum(w for _, w in x) for x in by.values()]) - 1) < 0.01
    for r in sampling.sample_segmentations(docs).collect():
        assert lat.decode(np.frombuffer(r.ids, "<u2")) in {t or "" for _, t in TEXTS}


def test_decoding_of_whole_tables(spark, docs, tmp_path):
    rows = sampling.decode(sampling.sample_segmentations(docs).select("doc_id", "ids")).collect()
    texts = collections.defaultdict(set)
    for d, t in TEXTS:
        texts[d].add(t or "")
    assert {r.doc_id for r in rows} == set(texts) and all(r.text in texts[r.doc_id] for r in rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sampling.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.text_crc32 in {zlib.crc32(t.encode()) for t in texts[r.doc_id]} for r in got)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://A.net/x", "https://b.example.net/en/1?x=/fr/", "x://b.example.net/fr/#a", "a://example.com/de/", "a://my.org/fr/q", "a://org/fr", "a://m.ads-track.example.com/en/", "a://xnet/", "a://u://v.net/", "a://casino-win.example.com/", "a://casino-win.example.org/fr/"]
    rows = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    got = [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "", None, "allow"), ("a.net", "/x", "net/", "block"),
        ("b.example.net", "/en/1", "example.net/en/", "allow"), ("b.example.net", "/fr/", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("my.org", "/fr/q", "org/fr/", "allow"),
        ("org", "/fr", None, "allow"), ("m.ads-track.example.com", "/en/", None, "block"), ("xnet", "/", None, "allow"), ("u:", "//v.net/", None, "allow"),
        ("casino-win.example.com", "/", None, "block"), ("casino-win.example.org", "/fr/", "org/fr/", "allow"),
    ]


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [0.5] * 8), (304, [0.5] * 8), (350, [0.5] * 8), (None, [1.0] * 8)]
    got = vector_search.exact_topk(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5), lanes=4).collect()
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v and None not in v and not np.isnan(v).any()}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[o]), o) for o in good if o != q)[:5]
        want |= {(q, rank, o, -s) for rank, (s, o) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_restoring():
    model = np.full((toxicity.CLASSES, toxicity.CLASSES), -5.0)
    for word in ("idiot", "moron", "scum"):
        for a, c in zip(f" {word}", f"{word} "):
            model[toxicity.LETTERS.find(a) + 1 if a != " " else 0, toxicity.LETTERS.find(c) + 1 if c != " " else 0] = -0.5
    r = toxicity.Restorer(model)
    assert r.restore(["1d10t", "i.d.i.o.t", "iiidiooot", "m0r0n", "$cum"]) == ["idiot", "idiot", "idiot", "moron", "scum"]
    assert toxicity.spaced_out("so i d i o t it is a b c".split()) == ["idiot"]


def test_doubled_letters_are_undone():
    model = np.zeros((toxicity.CLASSES, toxicity.CLASSES))
    weights = {f: 4.0 for w in ("moron", "scum", "trash", "asshole") for f in toxicity.features(w)}
    got = toxicity.Scorer(model, weights).evidence(["a mooron", "ssccuumm", "ttrash", "morron", "aasshhole", "m00ron", "a maroon", "asshole"])
    assert got == [4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 0.0, 4.0]


def test_words_are_found_across_white_space():
    model = np.zeros((toxicity.CLASSES, toxicity.CLASSES))
    weights = {f: 4.0 for w in ("moron", "scum", "idiot") for f in toxicity.features(w)}
    scorer = toxicity.Scorer(model, weights)
    once = ["he is a m o r o n", "y o u m o r o n", "m  o  r  o  n", "m\to\tr\to\tn", "m\no\nr\no\nn y o u", "a mo ron!", "m oo ro n", "m. o. r. o. n.", "s c u m y o u", "moron m o r o n", "i d i o t s"]
    assert scorer.evidence(once) == [4.0] * len(once)
    assert scorer.evidence(["y o u s c u m i d i o t", "more on scu", "a b c d e", "", None]) == [8.0, 0.0, 0.0, 0.0, 0.0]
    assert toxicity.Scorer(model, weights | {" moron": 0.0}).evidence(["mo ron", "a moron", "sc um"]) == [0.0, 4.0, 4.0]


def test_toxicity_and_quality_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
    scored = quality.quality(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    assert sum(r.keep == (r.label == 1) for r in scored) >= 0.97 * len(scored)
