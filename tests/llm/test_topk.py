import math
import random

from pyspark.sql import functions as F

from logloom.llm.topk import quantised, top_k

VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q and len(a) == len(b))
            out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s[:k])]
    return sorted(out)


def got(spark, rows, k):
    v = quantised(spark.createDataFrame(rows, VECTORS).repartition(3))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(v.where(F.col("id") % 20 == 0), v, k).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    vec = lambda d, scale: [float(rng.randint(-8, 8)) * scale for _ in range(d)]
    rows = [(i, vec(5, 0.125), "", "") for i in range(700)] + [(1000 + i, [0.5] * 5, "", "") for i in range(300)] + [(2000 + i, vec(3, 1e6), "", "") for i in range(60)]
    rows += [(4000, None, "", ""), (4020, [1.0, None, 1.0, 1.0, 1.0], "", ""), (4040, [math.nan] * 5, "", ""), (4060, [math.inf] * 5, "", ""), (None, [9.0] * 5, "", ""), (4001, [3.0] * 5, "", ""), (4001, [3.0] * 5, "", ""), (4080, [], "", "")]
    assert got(spark, rows, 20) == brute(rows, 20)


def test_fewer_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], "", ""), (1, [1.0, 1.0], "", ""), (2, [-1.0, 1.0], "", "")]
    assert got(spark, rows, 20) == brute(rows, 20)
    assert got(spark, [], 20) == []
