import random
from collections import defaultdict

from logloom.llm.mixing import mix, mixed

DOCS = "doc_id long, source string, text string, target string, copies string"


def want_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 3 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_targets_copies_and_reruns(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, rng.choice(["big"] * 6 + ["a", "b", "ß", "tiny", None]), None if i % 40 == 0 else "w " * rng.randint(0, 60), "", "") for i in range(1500)] + [(7, "void", "", "", ""), (8, "a", "x y", "", ""), (8, "a", "x y", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mix(docs.repartition(5)).collect()))
    sizes = defaultdict(int)
    for _, s, t, *_ in rows:
        sizes[s] += len((t or "").split())
    target = want_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - t) <= 3 * 60 for s, t in target.items())
    out = mixed(docs).collect()
    assert len(out) == sum(r.copies for r in got) and out[0].asDict().keys() == {"doc_id", "source", "text", "target", "copies"}


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], DOCS)).collect() == []
