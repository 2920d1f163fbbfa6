from collections import defaultdict

import corpus_pipeline
from logloom.llm.common import DOCUMENT_COLUMNS
from logloom.llm.packing import pack
from logloom.llm.queries import tokenizer_path


def test_stages_take_effect(spark, tmp_path):
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        text = f"shared line of many documents here\n" + " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(30)) + (" vexing scumface scumface" if toxic else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1], "en", "s0", 0) for i in range(1)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    clean = {i for i, _, y in labels if not y}
    assert clean <= {r.doc_id for r in seen["toxicity"]} and len({r.doc_id for r in seen["toxicity"]} & {i for i, _, y in labels if y}) <= 6
    assert len(seen["line_dedup"]) == len(seen["toxicity"]) and sum("shared line" in r.text for r in seen["line_dedup"]) == 1
    ids = {r.doc_id for r in seen["near_duplicates"]}
    assert 1 in ids and 1000 not in ids and {2000, 2001} <= ids
    copies = defaultdict(int)
    for r in seen["mixing"]:
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and set(copies) <= ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in out) == len(seen["mixing"]) and pack(docs, tokenizer_path()).count() == len(out)
