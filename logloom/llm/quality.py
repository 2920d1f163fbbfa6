"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram of character classes and of common words is compared with the reference
of its language by Jensen-Shannon distance. References cover all documents of the language: each
class's median share in whole thousandths, which a minority of junk does not move, and the sum of
common words. Documents too short for a stable histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, written

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "with",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "nicht", "ein", "auf",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "pour",
    "el", "y", "los", "se", "del", "las", "por", "con", "su", "al", "lo", "como",
)

#: Character classes: their regular expressions; what is in none counts as another class.
CHARACTER_CLASSES = (r"[\x20\x09-\x0D]", r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>@~^=+_/\\\[\]{}]")


#: References of so many languages, of some 60 numbers each, are broadcast.
MAX_BROADCAST_LANGUAGES = 1 << 14


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    #: At most so many percent of the words in repeated windows of so many words.
    window: int = 5
    repeat_percent: int = 20
    #: Largest Jensen-Shannon distances (base 2, 0 to 1), and the least characters or words to apply
    #: them. Short texts vary more: the first is raised by char_allowance / characters in words.
    max_char_distance: float = 0.1
    char_allowance: float = 60.0
    min_chars: int = 100
    max_word_distance: float = 0.75
    min_word_count: int = 100
    #: Common words among a language's words, at least, for them to say anything about its documents.
    min_common_share: float = 0.02


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use has it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int) -> Column:
    """Words within windows of `window` words that occur twice or more in the array."""

    def covered(w: Column) -> Column:
        n = F.size(w) - window + 1
        at = F.sequence(F.lit(1), n)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(window)]))

        def of_hashes(h: Column) -> Column:
            by_hash = lambda: F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == n, F.lit(0).cast("long")).otherwise(let(by_hash(), of_sorted))

        def of_sorted(g: Column) -> Column:
            last = F.size(g)
            same = lambda i, j: F.coalesce(F.try_element_at(g, i)["h"] == F.try_element_at(g, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(1), last), lambda i: (F.when(i > 1, same(i, F.greatest(i - 1, F.lit(1)))).otherwise(False)) | same(i, i + 1))
            return let(F.array_sort(F.transform(twice, lambda i: F.element_at(g, i)["i"])), spread)

        def spread(s: Column) -> Column:
            gaps = F.transform(s, lambda x, k: F.least(F.coalesce(F.try_element_at(s, k + 2), x + window) - x, F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return let(words, covered)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of the same length; null if one is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("double"), lambda a, x: a + x)

    def of(t: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        each = F.zip_with(p, q, lambda x, y: term(x / t["p"], (x / t["p"] + y / t["q"]) / 2) + term(y / t["q"], (x / t["p"] + y / t["q"]) / 2))
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(total(each) / 2, F.lit(0.0))))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def count_in(text: Column, character_class: str) -> Column:
    """Code points of text in a character class: what is lost when its runs are taken out."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{character_class}+", ""))


def measures(docs: DataFrame, rules: QualityRules, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts and the two histograms (arrays of double) of each document."""
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    common = F.filter(F.transform("words", lambda w: F.rtrim(F.lower(w), F.lit(".,"))), lambda w: w.isin(*COMMON_WORDS))
    count_of = lambda found: F.array(*[(F.size(found) - F.size(F.array_remove(found, w))).cast("double") for w in COMMON_WORDS])
    classes = F.array(*[count_in(F.col("text"), c).cast("double") for c in CHARACTER_CLASSES])
    return d.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{CHARACTER_CLASSES[0]}+", "")).cast("long").alias("word_chars"),
        count_in(F.col("text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.window).alias("n_repeat_words"),
        let(classes, lambda c: F.concat(c, F.array(F.greatest(F.length("text") - F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))).alias("chars"),
        let(common, count_of).alias("common"),
    )


def quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rule verdicts: <id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    char_distance, word_distance (double, null where nothing can be compared), base_failed, kept.

    Null texts are empty: no words, base_failed. A language in which the listed common words are rare
    is judged by character classes alone; in any other, a text of min_word_count words without one
    common word is as far off as can be. A null language has a reference of its own.
    Repeated rows count each. No rows in, no rows out. Other columns are ignored.
    """
    rules = rules or QualityRules()
    m = written(measures(docs, rules, id_col, text_col, lang_col), "measures")
    total = lambda c, n: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(n)])
    # One row a language; a median keeps at most 1001 values.
    share = lambda i: F.median(F.floor(1000 * F.element_at("chars", i + 1) / F.greatest(F.aggregate("chars", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))))
    ref = m.groupBy(F.col("lang").alias("l")).agg(F.array(*map(share, range(len(CHARACTER_CLASSES) + 1))).alias("ref_chars"), total("common", len(COMMON_WORDS)).alias("ref_common"), F.sum("n_words").alias("ref_words"))
    # A language may hold a third of all rows: where references are few, rows stay where they are.
    m = m.join(broadcast_if_small(written(ref, "references"), MAX_BROADCAST_LANGUAGES), F.col("lang").eqNullSafe(F.col("l")))
    m = m.withColumn("char_distance", divergence(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", divergence(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    chars_off = (F.col("word_chars") >= rules.min_chars) & (F.coalesce("char_distance", F.lit(0.0)) > rules.max_char_distance + rules.char_allowance / F.greatest("word_chars", F.lit(1)))
    covered = F.aggregate("ref_common", F.lit(0.0), lambda a, x: a + x) >= rules.min_common_share * F.greatest("ref_words", F.lit(1))
    words_off = covered & (F.col("n_words") >= rules.min_word_count) & (F.coalesce("word_distance", F.lit(1.0)) > rules.max_word_distance)
    return m.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance",
        failed.alias("base_failed"), (~failed & ~chars_off & ~words_off).alias("kept"),
    )
