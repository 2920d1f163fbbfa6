import random
import re
from collections import defaultdict
from itertools import permutations

from logloom.llm.filter_audit import audit

DOCS = "doc_id long, text string, lang string, part string, mask int, quality int"
LABELS = "doc_id long, quality int, toxic int, part string"


def failed(i, text, rows):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
    shown = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
    return {f for f, x in zip("ABCDE", shown, strict=True) if x}


def brute(rows, labels):
    good, toxic = ({i for i, q, t, *_ in labels if x(q, t)} - {None} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    parts = defaultdict(list)
    for i, t, lang, *_ in rows:
        parts[lang or ""].append((i, failed(i, t or "", rows)))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            here = list(docs)
            for step, f in enumerate(order, 1):
                lost, here, before = [d for d in here if f in d[1]], [d for d in here if f not in d[1]], set(order[: step - 1])
                shapley[f] += len(lost)
                gone = sum(f in x and bool(x & before) for _, x in docs)
                out[part, "".join(order), step] = [len(here), len(lost), gone, sum(x == {f} for _, x in docs), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def got(spark, rows, labels):
    r = audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    out = {(x.part, x.filter_order, x.step): list(x)[3:] for x in r}
    assert len(out) == len(r)
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([60, 400])], k=rng.randint(60, 160))) for _ in range(60)]
    texts += [t.upper() for t in texts[:9]] + [t + rng.choice(" #$%&*|") for t in texts[:20]] + ["", None, "É" * 50 + "A" * 5, "Ab", "a b\x0bc " * 4000, "<x> #\n"]
    rows = [(rng.choice([i, i, None]), rng.choice(texts), rng.choice(["de", "en", "", None]), "x", 1, 1) for i in range(300)]
    rows += [rows[5], rows[5], (7, texts[3], "de", "", 0, 0), (7, texts[3], "en", "", 0, 0), (6, texts[3], "fr", "", 0, 0)]
    labels = [(rng.randint(0, 300), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "") for _ in range(200)] + [(None, 1, 1, ""), (7, 1, 1, ""), (7, 1, 0, "")]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_counts_of_every_order_add_up(spark):
    rows = [(i, "same text # " * (1 + i % 2), "en", "", 0, 0) for i in range(40)]
    out = got(spark, rows, [])
    assert len(out) == 600 and all(x[0] + sum(out["en", o, s][1] for s in range(1, step + 1)) == 40 for (_, o, step), x in out.items())
    assert sum(out["en", "ABCDE", s][6] for s in range(1, 6)) == 120 * sum(out["en", "ABCDE", s][1] for s in range(1, 6))


def test_empty_table(spark):
    assert got(spark, [], [(1, 1, 1, "")]) == {}
