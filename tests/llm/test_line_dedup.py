import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from logloom.llm.line_dedup import apply_bitmaps, keep_bitmaps

DOCS = "doc_id long, text string, n_lines string, keep string"
UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UP, DOWN))

    where = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(-1 if doc is None else doc)
    drop = {k: max(v) for k, v in where.items() if len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), doc) == (-1 if doc is None else doc) or key(x) not in drop]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS).repartition(3)
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return sorted(repr((r.doc_id, r.line_counts.n_lines, r.line_counts.n_dropped, hashlib.sha256(r.text.encode()).hexdigest())) for r in kept.collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    lines = ["x" * 19, "x" * 20, "  " + "X" * 20 + "\t", "é" * 19, "É" * 20, "é" * 20, "", "short", *[f"line number {i} of the lot" for i in range(40)], "one line that nearly all of them have"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(300)]
    rows += [(None, "\n".join(lines)), (300, None), (301, ""), (302, "\n".join(lines * 50)), (5, rows[5][1])]
    assert got(spark, rows) == brute(rows)


def test_one_line_in_every_document_over_many_tasks(spark):
    rows = [(i, "the very same line in all documents\nand a line of its own: " + str(i)) for i in range(2000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_columns_with_the_operators_own_names(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", f"k{i}", 1.5, "x") for i in range(4)], "doc_id long, text string, keep string, fp double, line_counts string").withColumns({"row": F.lit(7), "id": F.lit("i")})
    got = {r.doc_id: r for r in apply_bitmaps(docs, keep_bitmaps(docs)).collect()}
    assert [got[i].text for i in range(4)] == ["own 0", "own 1", "own 2", f"{line}\nown 3"]
    assert all((r.keep, r.fp, r.row, r.id) == (f"k{i}", 1.5, 7, "i") and r.line_counts.n_lines == 2 for i, r in got.items())
