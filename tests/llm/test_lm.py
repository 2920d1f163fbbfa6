import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import lm

DOCS = "doc_id long, text string, score string, n_tokens string"


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    chain = {w: rng.sample(words, 4) for w in words}

    def text(n):
        w, out = rng.choice(words), []
        for _ in range(n):
            w = rng.choice(chain[w]) if rng.random() < 0.8 else rng.choice(words)
            out.append(w if rng.random() < 0.9 else w.upper())
        return " ".join(out)

    rows = [(i, text(rng.randint(0, 60)), "", "") for i in range(800)]
    return rows + [(None, "w1 w2", "", ""), (801, None, "", ""), (802, "new words only", "", ""), (5, rows[5][1], "", ""), (803, "w1 " * 20000, "", "")]


@pytest.mark.parametrize("broadcast", [lm.MAX_BROADCAST, 0])
def test_base_is_exact_and_model_predicts_better(spark, broadcast):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    train = F.coalesce(F.col("doc_id") % 10 != 0, F.lit(False))
    got = lm.score(docs, train, max_broadcast=broadcast).collect()
    tokens = lambda t: [*(t or "").lower().split(), "</s>"]
    c = Counter(x for i, t, *_ in rows if i is not None and i % 10 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t, *_ in rows)
    have = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if r.doc_id is not None and r.doc_id % 10 == 0]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in got)


def test_probabilities_after_a_history_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 1 << 63, 300, np.int64).astype(np.uint64) * np.uint64(2)
    t = vocabulary[np.minimum(rng.geometric(0.03, 40000), 299)]
    keys, counts = np.unique(lm.pairs(t), return_counts=True)
    words, often = np.unique(t, return_counts=True)
    h = (keys >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    types, once = np.diff(np.r_[start, len(h)]), np.add.reduceat((counts == 1).astype(np.int64), start)
    m = counts > 1
    bits = lm.segment_bits(lm.entries(keys[m], counts[m], h[start], types, once, 2))
    f = lm.Filter(np.frombuffer(bits, np.uint8), np.array([0]), np.array([8 * len(bits)]), 2)
    assert (lm.count_value(f.levels(lm.PAIR, keys[m]), 2) > counts[m] / 2 - 1e-9).all()
    for w in words[:40]:
        after = (w & np.uint64(0xFFFFFFFF00000000)) | (words >> np.uint64(32))
        _, p = lm.score_pairs(after, often, int(often.sum()), len(words), f)
        assert (10**p).sum() <= 1.02


def test_segments_score_as_the_broadcast_filter_does(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    train = F.coalesce(F.col("doc_id") % 10 != 0, F.lit(False))
    rows = lambda **k: sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs, train, **k).collect())
    want = rows()
    monkeypatch.setattr(lm, "BLOCK", 2000)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 2000)  # more segments than by default
    have = rows(max_broadcast=0)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-3, atol=1e-6)  # other segments, other false positives


def test_texts_that_occur_twice_score_above_those_seen_once(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, texts[i], "", "") for i in range(300)] + [(1000 + i, texts[i], "", "") for i in range(60)]
    for limit in (lm.MAX_BROADCAST, 0):
        got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, DOCS), F.lit(True), max_broadcast=limit).collect()}
        assert min(got[i] for i in range(60)) > max(got[i] for i in range(60, 300))


def test_nothing_to_learn_from(spark):
    for limit in (lm.MAX_BROADCAST, -1):
        assert lm.score(spark.createDataFrame([], DOCS), F.lit(True), max_broadcast=limit).collect() == []
    r = lm.score(spark.createDataFrame([(1, "a b", "", "")], DOCS), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_counts_beyond_32_bits_come_back_whole():
    for x in ([], [0], [1, 255], [256, 0], [2**32 - 1, 2**32, 2**40 + 5, 2**62], [7] * 1000):
        x = np.array(x, np.int64)
        assert lm._from_planes(lm._planes(x)).tolist() == x.tolist()
    s = lm.Segment(b"", np.array([5, 9], np.uint64).tobytes(), np.array([2**33, 1], np.int64).tobytes())
    assert lm._from_planes(lm._planes(s.count(np.array([5, 6, 9], np.uint64)))).tolist() == [2**33, 0, 1]


def test_runs_of_segments():
    rng = np.random.default_rng(3)
    for n, segments in ((0, 7), (1, 1), (500, 3), (40, 100_000)):
        keys = np.sort(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2))
        runs = list(lm.by_segment(keys, segments))
        of = lm.segment_of(keys, segments).tolist()
        assert [s for s, a, b in runs for _ in range(a, b)] == of and [s for s, *_ in runs] == sorted(set(of))
