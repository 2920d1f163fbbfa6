import random
from itertools import combinations

import numpy as np
import pytest

from logloom.llm.ngram_join import Bands, link_tile, linked, near_duplicates, representatives, width

DOCS = "doc_id long, text string, component_id string, n_shingles string"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words)} if len(words) < n else {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(map(repr, ((doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))))


def got(spark, rows, n, percent, **kw):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS).repartition(3)
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in near_duplicates(docs, n, percent, **kw).collect())


def family(rng, size, copies, edits):
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = [rng.choice("xyz") + str(rng.randint(0, 9))] * rng.choice([0, 1])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = [t for size, edits in ((3, 1), (6, 1), (9, 2), (12, 2), (30, 3), (80, 6), (200, 12), (700, 40)) for _ in range(6) for t in family(rng, size, 6, edits)]
    texts += ["", None, " \t\n", "One two", "one  TWO", "É a", "é a", "a b c d e f g " * 3000]
    rows = list(enumerate(texts)) + [(None, texts[40]), (7, texts[90]), (8, texts[8])]
    assert got(spark, rows, n, percent) == brute(rows, n, percent)


def test_small_blocks_find_the_same(spark):
    rng = random.Random(5)
    rows = list(enumerate([t for size, edits in ((60, 9), (200, 30)) for t in family(rng, size, 60, edits)]))
    assert got(spark, rows, 4, 85, block=7) == brute(rows, 4, 85)


def test_representatives(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "", ""), (2, "A b c d e f", "", ""), (3, "", "", ""), (4, None, "", ""), (5, "q r s t u v", "", "")], DOCS)
    assert sorted(r.doc_id for r in representatives(docs).collect()) == [1, 3, 4, 5]


def test_empty_table(spark):
    assert got(spark, [], 4, 85) == []


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f"
    docs = spark.createDataFrame([(1, text, "x", ""), (1, text, "x", ""), (1, "A b  c d e f", "", ""), (None, text, "", ""), (None, "q r s t u v", "", ""), (None, "q r s t u v", "", ""), (3, None, "", ""), (3, None, "", "")], DOCS)
    assert sorted((str(r.doc_id), r.text and r.text.lower().replace("  ", " ")) for r in representatives(docs).collect()) == [("1", text), ("3", None), ("3", None), ("None", "q r s t u v")]


def test_wide_signatures_still_bound():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 9000, np.uint64)
    sets = sorted((np.unique(np.r_[base[: 9000 - d], rng.integers(0, 2**63, d, np.uint64)]) for d in (0, 300, 900, 4000, 8000)), key=len)
    assert width(9000) == 32768 and width(1) == 1024
    found = link_tile(list(range(len(sets))), sets, 80)
    groups = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if linked(sets[i], sets[j], 80):
            groups[j] = groups[i] = min(groups[i], groups[j])
    assert len(found) == len(sets) - len(set(groups))


def test_tiles_of_a_set_beyond_any_text():
    bands = Bands(80, 1 << 40)
    assert bands.of(30_000_000) > bands.of(16_000_000) and bands.parts(bands.of(30_000_000) + 1)[0] > 1_000_000
