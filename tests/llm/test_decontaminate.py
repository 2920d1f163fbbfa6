import random
import re

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id string, n_words int, items string"
BENCH = "item_id long, text string, doc_id long, spans string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window):
    out = []
    for i, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for item, t, *_ in bench:
            x = words(t)
            k = min(window, len(x))
            windows = {tuple(x[p : p + k]) for p in range(len(x) - k + 1)} if k else set()
            at = [p for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in windows] if k else []
            hit |= {p + j for p in at for j in range(k)}
            items |= {"" if item is None else str(item)} if at else set()
        spans = [p for p in sorted(hit) if p - 1 not in hit], [p + 1 for p in sorted(hit) if p + 1 not in hit]
        out.append((i, len(w), len(hit), list(zip(*spans, strict=True)), sorted(items)))
    return out


def brute_longest(docs, bench, window):
    out = {}
    for item, t, *_ in bench:
        x = words(t)
        k = min(window, len(x))
        for p in range(len(x) - k + 1) if k else []:
            best = 0
            for _, text, *_ in docs:
                w = words(text)
                for q in range(len(w)):
                    n = 0
                    while p + n < len(x) and q + n < len(w) and x[p + n] == w[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= k:
                name = "" if item is None else str(item)
                out[name, p] = max(best, out.get((name, p), 0))
    return out


def tables(seed, n):
    rng = random.Random(seed)
    some = ["a", "B", "b", "cc", "é", "É", "漢字", "x1", "y_z", "0", "the", "The", "q q"]
    text = lambda k: "".join(rng.choice(some) + rng.choice([" ", " ", "\n", ". ", "-", "\x7f"]) for _ in range(k))
    bench = [(i, text(rng.choice([0, 1, 2, 3, 4, 5, 9])), 1, "") for i in range(12)] + [(None, "null id has words", 1, ""), (3, None, 1, ""), (50, "!!! ...", 1, ""), (51, "", 1, ""), (52, "a b cc a b cc a b cc", 1, ""), (52, "a b cc a b cc a b cc", 1, "")]
    docs = [(i if i % 9 else None, text(rng.randint(0, 60)), "", 0, "") for i in range(n)] + [(7, None, "", 0, ""), (8, "", "", 0, ""), (9, "a b cc " * 3000, "", 0, ""), (9, "x NULL-ID\thas... words y", "", 0, ""), (9, "has words null id", "", 0, "")]
    return docs + docs[3:5], bench


def got(spark, docs, bench, window):
    r = d.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), window).collect()
    return sorted(repr((x.doc_id, x.n_words, x.n_hit, [tuple(s) for s in x.spans], x.items)) for x in r)


@pytest.mark.parametrize("shard", [200, 8 << 20])
def test_against_brute_force(spark, monkeypatch, shard):
    docs, bench = tables(12, 150)
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    assert got(spark, docs, bench, 4) == sorted(map(repr, brute(docs, bench, 4)))


def test_blocks_of_test_items_give_the_same(spark, monkeypatch):
    docs, bench = tables(13, 60)
    want = sorted(map(repr, brute(docs, bench, 3)))
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    assert got(spark, docs, bench, 3) == want


def test_longest_matches(spark):
    docs, bench = tables(14, 40)
    docs = docs[:40]
    r = d.longest_matches(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), 3).collect()
    assert {(x["item"], x.item_start): x.length for x in r} == brute_longest(docs, bench, 3)
    by_text = {}
    for i, t, *_ in bench:
        by_text.setdefault("" if i is None else str(i), []).append(words(t))
    texts = {}
    for i, t, *_ in docs:
        texts.setdefault(i, []).append(words(t))
    assert all(any(x[m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length] for x in by_text[m["item"]] for w in texts[m.doc_id]) for m in r)


def test_affected_documents_go(spark):
    docs, bench = tables(15, 80)
    clean = [r for r, b in zip(docs, brute(docs, bench, 4), strict=True) if not b[2]]
    left = d.decontaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), 4).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, clean))


def test_empty_tables(spark):
    docs, bench = tables(16, 5)
    assert got(spark, [], bench, 10) == []
    assert got(spark, docs, [], 10) == sorted(map(repr, brute(docs, [], 10)))
    assert d.decontaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], BENCH)).count() == len(docs)
    assert d.longest_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], BENCH)).collect() == []


def test_words_that_share_a_hash(monkeypatch):
    b = d.build(["1"], pa.array(["one two three"]), 3)
    w = d.split_words(pa.array(["one two four", "one two three"]))
    w.hash[2] = w.hash[5]
    assert d.find(w, b, False).hit.tolist() == [False] * 3 + [True] * 3


def test_words_of_any_length(monkeypatch):
    rng = random.Random(17)
    texts = ["".join(rng.choices("ab é,", k=rng.randint(0, 300))) for _ in range(50)]
    whole = d.split_words(pa.array(texts))
    monkeypatch.setattr(d, "HASH_BYTES", 7)
    again = d.split_words(pa.array([None, *texts]).slice(1))
    assert np.array_equal(whole.hash, again.hash) and [whole.folded[a:b].tobytes().decode() for a, b in zip(whole.start, whole.end, strict=True)] == [w for t in texts for w in words(t)]
