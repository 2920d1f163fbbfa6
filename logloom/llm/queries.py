"""Contract queries of the operators, op<N>_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table
from .chat import format_chat, read_loss, read_turns
from .decontaminate import contamination
from .filter_audit import audit
from .fim import fill_in_middle, restored
from .line_dedup import apply_bitmaps, keep_bitmaps
from .lm import score
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack
from .quality import quality
from .token_counts import token_counts
from .topk import quantised, top_k
from .toxicity import toxicity

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity(docs, docs, labels)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM s
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () AS total FROM w
), l AS (
  SELECT *, CAST(total - before AS DOUBLE) / CAST(weights AS DOUBLE) AS own FROM f
), v AS (
  SELECT *, first_value(CASE WHEN most >= own * weight THEN own END IGNORE NULLS) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM l
), t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), level * weight) AS target,
    CAST(CAST('0x' || substr(md5('20|' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start FROM v
), r AS (
  SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(start + i * rate) - floor(start + (i - 1) * rate) AS BIGINT) * size AS taken FROM r
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) != 0, stable=True)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    f = format_chat(rows.unionByName(probe))
    f = f.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _op9_sql() -> str:
    from .chat import BODY, END, TURN, ChatTemplate

    t = ChatTemplate()
    escaped = "replace({}, '\\', '\\\\')"
    for s in (*t.control, *map(t.placeholder, t.part_tokens)):
        escaped = f"replace({escaped}, '{s}', '{s[0]}\\-{s[1:]}')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END)} + length({escaped.format('role')}) + length({escaped.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("id") % 20 == 0), vectors, 20)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT [a, b, c, d, e] AS fs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT array_to_string(list_transform(fs, lambda x: x.f), '') AS filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step - 1]) AS INTEGER) AS before FROM orders, unnest([1, 2, 3, 4, 5]) AS t(step)
), r AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & coalesce(before, 0) <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS toxic_lost FROM m, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r
"""


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_ITEM_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH b AS (
  SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_ITEM_WORDS} AS w FROM documents
), p AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM v))
), o AS (
  SELECT DISTINCT doc_id, i, k, item_id FROM p JOIN v USING (k, win)
), h AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS at FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return f.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Code points before each token stand for the cuts; what is restored must be the text itself.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes FROM documents
), c AS (
  SELECT doc_id, text, sizes, len(sizes) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d
), u AS (
  SELECT *, CAST(coalesce(list_sum(sizes[1:least(hs[1] % (n + 1), hs[2] % (n + 1))]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[1:greatest(hs[1] % (n + 1), hs[2] % (n + 1))]), 0) AS BIGINT) AS b,
    text = '' OR regexp_matches(text, '<[PSM]>') OR hs[3] % 100 >= 90 AS plain FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN hs[4] % 100 < 20 THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256 FROM u
"""


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_ngram_jaccard_join, op4_quality_rules, op5_toxicity, op6_mixing, op7_lm_scoring, op8_token_counts, op9_chat_formatting, op10_exact_top_k, op11_filter_interaction_audit, op12_benchmark_decontamination, op13_fill_in_middle)}
SQL = {"op2_line_dedup": OP2_SQL, "op6_mixing": OP6_SQL, "op9_chat_formatting": _op9_sql(), "op10_exact_top_k": OP10_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_benchmark_decontamination": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
