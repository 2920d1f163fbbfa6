import math
import random
import re
from collections import Counter

from logloom.llm.quality import CHARACTER_CLASSES, QualityRules, divergence, quality
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, kept string, n_words string"
BLANK = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_measures_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c#", "dé\n", "|", "<e>\t"], k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["", None, "x y z w v " * 3000, "same line\nsame line\n \n \nother", "one", "a b c d e a b c d e"]
    rows = [(i if i % 30 else None, t, [None, "en", "de"][i % 3], "", "") for i, t in enumerate(texts)] + [(7, texts[7], "en", "", "")]
    got = quality(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(repr((i, *base(t))) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_divergence(spark):
    p, q = [3.0, 0.0, 1.0], [1.0, 1.0, 0.0]
    row = spark.range(1).select(divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), divergence(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("n")).first()
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert math.isclose(row.d, math.sqrt((kl(a) + kl(b)) / 2)) and row.n is None


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(10)
    words = ["the", "of", "and", *("".join(rng.choices("aeioulmnrst", k=rng.randint(3, 8))) for _ in range(300))]
    clean = [" ".join(rng.choices(words, weights=[60, 40, 40] + [1] * 300, k=rng.randint(60, 300))).capitalize() + "." for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "%%%", "|"]) for w in rng.choices(words, k=200)) for _ in range(40)]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame([(i, t, "en", "", "") for i, t in enumerate(clean + junk)], DOCS), QualityRules()).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 340))
    assert len(CHARACTER_CLASSES) == 6 and quality(spark.createDataFrame([], DOCS)).collect() == []


def test_a_language_without_listed_words_is_judged_by_characters(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("абвгдежзиклмнопрстуя", k=rng.randint(2, 9))) for _ in range(300)]
    clean = [" ".join(rng.choices(words, k=150)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "%%%", "|"]) for w in rng.choices(words, k=150)) for _ in range(6)]
    rows = [(i, t, "ru", "", "") for i, t in enumerate(clean + junk)] + [(100, clean[0] + " the of", "ru", "", "")]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in [*range(60), 100]) and not any(got[i] for i in range(60, 66))
