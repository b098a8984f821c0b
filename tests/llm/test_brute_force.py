"""Operators against independent versions of what they compute, and odd tables."""

import collections
import itertools
import math

import numpy as np
import pytest

from tidemark.llm import bloom, exact_dedup, ngram_join, packing, quality, sampling, toxicity, unigram, url_filter, vector_search

ODD = "doc_id long, text string, _text string, _toxicity double, _quality int, _weak int, _row int, row int, `a.b` string, score double, _kept long"
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six seven eight nine ten eleven twelve"), (4, "one two three four five six seven eight nine ten eleven twelve"), (None, "the same"), (5, "w" * 30_000), (6, "$1" * 9_000), (7, "a " * 5_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "x", 0.5, 1, 2, 3, 4, "y", 0.1, 9) for d, t in TEXTS], ODD)


def test_stages_keep_any_columns(spark, odd):
    labels = spark.createDataFrame([(4, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    for kept in (toxicity.not_toxic(odd, labels), quality.good(odd), exact_dedup.distinct_texts(odd), ngram_join.one_of_each(odd)):
        assert kept.columns == odd.columns
        assert all(r["a.b"] == "y" and r._kept == 9 and (r.doc_id, r.text) in TEXTS for r in kept.collect())


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0), (4, 1), (2, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and not [r for r in got if r.doc_id is None][0].held_out
    got = quality.quality(odd).collect()
    assert len(got) == len(TEXTS) and len({r.quality for r in got if r.doc_id in (1, 2)}) == 1
    got = {r.doc_id: r for r in unigram.token_counts(odd).collect()}
    assert (got[1].n_tokens, got[1].score, got[2].n_tokens) == (0, 0.0, 0) and got[5].n_tokens > 0
    assert packing.pack(odd).count() >= len(TEXTS)
    urls = spark.createDataFrame([(1, "http://a.net/", 1, 2), (1, None, 1, 2)], "page_id long, url string, host int, _fit int")
    assert sorted((r.host, r.verdict) for r in url_filter.url_filter(urls).collect()) == [("", "allow"), ("a.net", "block")]
    vectors = spark.createDataFrame([(0, [1.0, 2.0], 1, 2), (0, [3.0, 1.0], 1, 2), (7, [1.0, 1.0], 1, 2), (8, [], 1, 2)], "vec_id long, embedding array<float>, block int, lane int")
    assert [(r.query_id, r.rank, r.vec_id) for r in vector_search.exact_topk(vectors).collect()] == [(0, 1, 7), (0, 1, 7)] or len(vector_search.exact_topk(vectors).collect()) <= 2


def test_samples_against_enumeration():
    """Log probabilities of all segmentations, from the vocabulary file alone."""
    path = sampling.model_path()
    vocabulary = sampling.pieces(path)
    normal = {p: s for p, s, k in vocabulary if k == 1 and sampling.MARK not in p[1:]}
    total = math.log(sum(1 / (2 - s) for s in normal.values()))
    of = {i: p for i, (p, _, _) in enumerate(vocabulary)}
    lat = sampling.lattices(path)
    for text in ("then on", "a.b", "in\nto", "中a"):
        marked = sampling.MARK + text.replace(" ", sampling.MARK)
        every = []

        def walk(at, pieces, logp, marked=marked, every=every):
            if at == len(marked):
                every.append((tuple(pieces), logp))
                return
            for end in range(at + 1, len(marked) + 1):
                piece = marked[at:end]
                if piece in normal:
                    walk(end, [*pieces, piece], logp - math.log(2 - normal[piece]) - total)
                elif end == at + 1:
                    raw = piece.encode()
                    walk(end, [*pieces, *(f"<0x{b:02X}>" for b in raw)], logp + sampling.BYTE_LOGP * len(raw))

        walk(0, [], 0.0)
        logs = dict(every)
        mass = math.log(sum(map(math.exp, logs.values())))
        found = collections.defaultdict(list)
        for d, rank, ids, logp, gumbel, _ in sampling.top_k(lat, np.arange(300), [text] * 300, 2, 11):
            pieces = tuple(of[int(i)] for i in ids)
            assert logp == pytest.approx(logs[pieces] - mass, abs=1e-9)
            found[d].append((rank, pieces, gumbel))
        assert all(len({p for _, p, _ in x}) == len(x) == min(2, len(logs)) and (len(x) < 2 or x[0][2] > x[1][2]) for x in found.values())
    assert lat.decode_all([np.array([], int), np.array([lat.by_piece["▁a"]])]) == ["", "a"]


def test_long_segments():
    lat = sampling.lattices(sampling.model_path())
    text = "abc" * 12_000 + "\n" + "$" * 9_000
    for _, _, ids, logp, _, _ in sampling.top_k(lat, np.array([1]), [text], 2, 3):
        assert lat.decode(ids) == text and math.isfinite(logp)


def test_restoring_against_enumeration():
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(toxicity.CLASSES), toxicity.CLASSES))
    restorer = toxicity.Restorer(model)
    letters = list("abmo013$!.-@ii")
    tokens = ["".join(rng.choice(letters, int(rng.integers(1, 7)))) for _ in range(200)]
    for token, got in zip(tokens, restorer.restore(tokens), strict=True):
        best = (-math.inf, "")
        for path in itertools.product(*restorer.options(token)):
            before, score, word = 0, 0.0, ""
            for kind, logp in path:
                score += logp
                if kind >= 0:
                    score += model[before, kind]
                    before = kind
                    word += toxicity.LETTERS[kind - 1] if kind < toxicity.CLASSES - 1 else "·"
            best = max(best, (score + model[before, 0], word))
        assert got == best[1], token


def test_weak_labels_against_plain_em():
    rng = np.random.default_rng(3)
    n = len(quality.LABELLERS)
    truth = rng.random(4000) < 0.3
    right = rng.uniform(0.6, 0.95, n)
    votes = np.where(rng.random((4000, n)) < 0.5, 0, np.where((rng.random((4000, n)) < right) == truth[:, None], 2, 1))
    patterns = collections.Counter(int(sum(v << 2 * i for i, v in enumerate(row))) for row in votes.tolist())
    model = quality.WeakModel(patterns)
    p = {c: 0.9 if any(c >> 2 * i & 3 == 2 for i in range(n)) else 0.02 for c in patterns}
    for _ in range(200):
        total = [sum(w * (p[c] if k else 1 - p[c]) for c, w in patterns.items()) for k in (0, 1)]
        prior = [(t + 1) / (sum(total) + 2) for t in total]
        rate = [[[0.0] * 3 for _ in range(n)] for _ in (0, 1)]
        for c, w in patterns.items():
            for i in range(n):
                for k in (0, 1):
                    rate[k][i][c >> 2 * i & 3] += w * (p[c] if k else 1 - p[c])
        for k in (0, 1):
            for i in range(n):
                for v, add in enumerate((1.0, 1.0, 1.0 if k else 0.05)):
                    rate[k][i][v] += add
        new = {}
        for c in patterns:
            odds = math.log(prior[1] / prior[0])
            for i in range(n):
                v = c >> 2 * i & 3
                if v:
                    odds += math.log(rate[1][i][v] / (rate[1][i][1] + rate[1][i][2])) - math.log(rate[0][i][v] / (rate[0][i][1] + rate[0][i][2]))
            new[c] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        done = max(abs(new[c] - p[c]) for c in p) < 1e-9
        p = new
        if done:
            break
    assert all(model.posterior(c) == pytest.approx(p[c], abs=1e-7) for c in patterns)
    assert np.mean([(p[int(sum(v << 2 * i for i, v in enumerate(row)))] > 0.5) == t for row, t in zip(votes.tolist(), truth, strict=True)]) > 0.9


def test_best_scores_against_enumeration():
    viterbi = unigram.counter(unigram.model_path())
    score = {p: s for p, s, _ in unigram.pieces(unigram.model_path())}

    def best(s):
        top = [0.0] + [-math.inf] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(end):
                if s[start:end] in score:
                    top[end] = max(top[end], top[start] + score[s[start:end]])
            if s[end - 1] not in score:
                top[end] = max(top[end], top[end - 1] + viterbi.unknown)
        return top[-1]

    for text in ("then on", "a.b c", "中 x", "in  to", "\n", "é€"):
        assert viterbi.text(text).real == pytest.approx(sum(best(unigram.MARK + x) for x in unigram.segments(text)))


def test_components_of_chains(spark, monkeypatch):
    """Rounds grow with the logarithm of the longest path."""
    rounds = []
    real = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: rounds.append(name) or real(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in ngram_join.components(edges).collect()}
    assert set(got) == {*range(301), 1000, 1001} and all(c == (1000 if n >= 1000 else 0) for n, c in got.items())
    assert rounds.count("join-low") <= 14, rounds.count("join-low")


def test_bloom_filter(spark):
    keys = spark.range(5000).select("id").withColumnRenamed("id", "key")
    level = bloom.Level(3, 5000, 0.01).fill(keys.filter("key % 2 = 0"))
    passed = keys.filter(level.passes(keys["key"])).count()
    assert 2500 <= passed <= 2600
