import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import fim
from logloom.llm.fim import FimSpec, fill_in_middle, restored

DOCS = "doc_id long, text string, n string, form string, output string"


def brute(i, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    pre, mid, suf = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(t), "plain", None, None, text, text
    if h4 % 100 < 20:
        return i, len(t), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return i, len(t), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def got(spark, rows):
    f = fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(3))
    return [tuple(r) for r in f.withColumn("text", restored(F.col("output"), F.col("form"))).collect()]


ODD = ["", None, "<P>", "a <S> b", "x<M", "<", "<<P", "P>", "\n\r\x0b\x0c\x00\x01", "ÄÖ é́ 👩‍👧   ſK", "A" * 50, "a1" * 40_000, " ", "'\"\\$1 {} %s"]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    texts = ODD + ["".join(rng.choices(["word", "Zz", " ", "\n", "é", "漢", "<", ">", "<S", "M>", "1", "<P"], k=rng.randint(1, 80))) for _ in range(400)]
    rows = [(i if i % 50 else None, t, "", "", "") for i, t in enumerate(texts)] + [(3, texts[3], "", "", "")] * 2 + [(-5, "negative id", "", "", ""), (2**62, "large id", "", "", "")]
    want = sorted(map(repr, (brute(i, t) for i, t, *_ in rows)))
    assert sorted(map(repr, got(spark, rows))) == want
    assert {x[2] for x in map(eval, want)} == {"plain", "psm", "spm"}


def test_pieces_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "PIECE_BYTES", 10)
    for texts in ([], [None], ["a" * 35, "b", None, "c" * 9, "d", "e" * 100, "f"]):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        assert [i for p in fim._pieces(batch) for i in p["doc_id"].to_pylist()] == list(range(len(texts)))


def test_empty_table_and_markers(spark):
    assert got(spark, []) == []
    with pytest.raises(ValueError):
        FimSpec(prefix="<P>", suffix="<P>")
