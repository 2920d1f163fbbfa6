import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.llm.toxicity import CONTEXT_BITS, GRAM_BITS, ORDER, Model, Spelling, features, gram_counts, toxicity, without_toxic

DOCS = "doc_id long, text string, lang string, score string"


def corpus(n=900):
    rng = random.Random(8)
    plain = ["".join(rng.choices("bdglmnrst", k=2)) + rng.choice("aeiou") + rng.choice(["n", "r", ""]) for _ in range(400)]
    bad = ["vexik", "quoxor", "zzupid"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=rng.randint(20, 80))
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "es", ","]))
        rows.append((i, " ".join(words), "x", ""))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "vexik quoxor zzupid", "", ""), (2000, None, "", ""), (2001, "", "", ""), (3, rows[3][1], "", ""), (2002, "ban " * 20000, "", "")]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (1, None), (2000, 0)], "doc_id long, toxic int")
    got = toxicity(docs, docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 2000 and r.doc_id % 5 == 0]
    assert np.mean(right) > 0.95
    kept = {r.doc_id for r in without_toxic(docs, docs, known).select("doc_id").collect()}
    clean = {i for i, y in labels if not y}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept - clean - {None, 2000, 2001, 2002}) <= 15 and {2000, 2001} <= kept


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus(10)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, docs, none).collect()} == {0.5}
    assert toxicity(docs.where(F.lit(False)), docs, none).collect() == []


def test_grams_stay_within_words():
    a, b = Spelling([b"ab", b"", b"cde"]), Spelling([b"cde"])
    assert (a.hash[3][-3:] == b.hash[3][-3:]).all() and features(np.empty(0)) == (0.0,) * 4


def brute_ratio(texts, word):
    """Kneser-Ney by dictionaries: a class's own counts for the longest gram, shared continuation counts below."""
    spell = lambda w: "\x01" + w + "\x02"
    own, seen = [Counter(), Counter()], set()
    for cls, text in texts:
        for w in map(spell, text.split()):
            for i in range(1, len(w)):
                longest = min(i + 1, ORDER)
                own[cls][w[i + 1 - longest : i + 1]] += 1
                seen |= {w[i + 1 - k : i + 1] for k in range(2, longest + 1)}
    after = Counter(g[1:] for g in seen if len(g) > 2)  # grams that end with it
    inner = {g: after[g] for g in seen if len(g) < ORDER and after[g]}
    letters = Counter(g[1:] for g in seen if len(g) == 2)

    def level(counts, k, gram, below):
        of = {g: n for g, n in counts.items() if len(g) == k}
        n1, n2 = (sum(n == x for n in of.values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
        here = {g: n for g, n in of.items() if g[:-1] == gram[:-1]}
        total = sum(here.values())
        if not total:
            return below
        return min(max(here.get(gram, 0) - d, 0) / total, 1) + min(max(1 - sum(max(n - d, 0) for n in here.values()) / total, 0.01), 1) * below

    logs = [0.0, 0.0]
    w = spell(word)
    for i in range(1, len(w)):
        longest, below = min(i + 1, ORDER), (letters[w[i]] + 0.5) / (sum(letters.values()) + 0.5 * len(letters) + 128)
        for k in range(2, longest):
            below = level(inner, k, w[i + 1 - k : i + 1], below)
        for c in (0, 1):
            logs[c] += math.log(level(own[c], longest, w[i + 1 - longest : i + 1], below))
    return logs[1] - logs[0]


def test_ratios_against_dictionaries(spark):
    rng = random.Random(4)
    make = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    # So few grams that none share a place of the hashed tables.
    known = [make("abcd") for _ in range(14)]
    texts = [(c, " ".join(rng.choices(known[: 10 if c else 14], k=6) + [make("abcde")])) for c in (0, 0, 0, 1) for _ in range(6)]
    model = Model(gram_counts(spark.createDataFrame([(bytearray(t.encode()), c) for c, t in texts], "t binary, cls int")).toArrow())
    words = known + [make("abcdefg") for _ in range(25)] + ["a", "abcdefghij"]
    got = model.ratios([w.encode() for w in words])
    want = [brute_ratio(texts, w) for w in words]
    assert not [(w, a, b) for w, a, b in zip(words, got, want, strict=True) if not math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-4)]


def test_an_expression_of_few_labelled_documents_tells(spark):
    rows, labels = corpus()
    rows = [(i, t + " brimzork brimzork" if i in (6, 12, 18, 24) else t, x, s) for i, t, x, s in rows]
    new = [(5000 + i, rows[100 + i][1] + w, "x", "") for i in range(3) for w in (" brimzork",) if not labels[100 + i][1]]
    docs = spark.createDataFrame(rows + new, DOCS)
    got = {r.doc_id: r.score for r in toxicity(docs, docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert new and all(got[i] > 10 * got[i - 4900] for i, *_ in new)


def test_workers_take_bounded_parts_of_text_and_words(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from logloom.llm import toxicity as t

    texts = [b"x" * n if n is not None else None for n in (10, 900_000, 400_000, None, 3_000_000, 0, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(7))], names=["t", "i"])
    parts = list(t._parts(batch, batch.column(0), 3))
    assert [x for p in parts for x in p.column(1).to_pylist()] == list(range(7)) and [p.num_rows for p in parts] == [2, 2, 1, 2]
    assert not list(t._parts(batch.slice(0, 0), batch.column(0).slice(0, 0), 3))
    taken, model = [], object.__new__(t.Model)
    monkeypatch.setattr(t.Model, "_ratios", lambda self, words: taken.append(len(words)) or np.array([float(len(w)) for w in words]))
    words = [b"a" * (i % 7) for i in range(20_000)]
    assert model.ratios(words).tolist() == [len(w) for w in words] and max(taken) == t.PART_WORDS and model.ratios([]).shape == (0,)


def test_tables_are_made_in_bounded_memory():
    """The driver makes them: beside the tables, a few arrays as long as the counts."""
    import tracemalloc

    rng, rows = np.random.default_rng(1), 1_000_000
    most = {"cls": 2, "k": (2, 7), "gram": 1 << GRAM_BITS, "context": 1 << CONTEXT_BITS, "suffix": 1 << GRAM_BITS, "initial": 2}
    counts = pa.table({k: rng.integers(*(x if isinstance(x, tuple) else (0, x)), rows).astype(np.int32) for k, x in most.items()} | {"n": rng.integers(1, 9, rows)})
    tracemalloc.start()
    try:
        Model(counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90e6
