"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models spell words byte by byte, one learnt from toxic text and one
from ordinary text. Spelling lets them know inflected and compounded expressions. A class has counts
of its own for the longest gram at a byte only; all lower orders are shared, so what either class has
rarely seen falls back on the continuation counts of both. Discounts are estimated for each order.
A document's score compares the length-normalised log-likelihoods over the whole text and over its
most telling words, through a logistic curve fitted on labelled rows that the counts have not seen.

Counts live in hashed tables of fixed size, so what goes to the driver and the workers is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in the longest gram.
ORDER = 6
#: log2 of the table sizes for grams and for contexts.
GRAM_BITS, CONTEXT_BITS = 21, 20
#: Labelled rows that are learnt from at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Bytes of texts and number of words that a worker takes at a time: its tables for each of their bytes take some 150 bytes.
PART_BYTES, PART_WORDS = 1 << 20, 1 << 13
#: Words of a stretch.
STRETCH = 12
_START, _STOP = b"\x01", b"\x02"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation and symbols at their ends."""
    return [w.strip(b".,;:!?\"'()*%&$#|") for w in (text or b"").lower().split()]


class Spelling:
    """The grams of words laid end to end: for each order, hashes of gram and context, and where they lie within a word."""

    def __init__(self, words: list[bytes]):
        text = b"".join([_START + w + _STOP for w in words])
        self.bytes = np.frombuffer(text, np.uint8)
        length = np.array([len(w) + 2 for w in words], np.int64)
        self.start = np.r_[0, np.cumsum(length)[:-1]]
        self.word = np.repeat(np.arange(len(words)), length)
        self.at = np.arange(len(self.bytes)) - self.start[self.word]
        self.hash = [np.full(len(self.bytes), 0x1234567, np.uint64)]
        for _ in range(ORDER):
            self.hash.append(_mix(np.r_[self.hash[0][:1], self.hash[-1][:-1]] * np.uint64(0x9E3779B97F4A7C15) + self.bytes + np.uint64(1)))

    def order(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions with a gram of order k, and the table places of gram, context and suffix."""
        i = np.flatnonzero(self.at >= max(k - 1, 1))
        return i, _place(self.hash[k][i], GRAM_BITS), _place(self.hash[k - 1][i - 1], CONTEXT_BITS), _place(self.hash[k - 1][i], GRAM_BITS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _parts(batch: pa.RecordBatch, text: pa.Array, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in order, by parts of so many rows and PART_BYTES of text at most, or one row."""
    size = np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float))
    first, held = 0, 0.0
    for at, n in enumerate(size.tolist()):
        if at > first and (at - first == rows or held + n > PART_BYTES):
            yield batch.slice(first, at - first)
            first, held = at, 0.0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(cls, k, gram, context, suffix, initial, n) of rows (t binary, cls int): how often each gram occurs, by places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b, b.column(0), 500)):  # tables of all grams of so many texts
            found = [Counter(), Counter()]
            for text, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[cls].update(words_of(text))
            for cls, counts in enumerate(found):
                if not counts:
                    continue
                s, often = Spelling(list(counts)), np.array(list(counts.values()), np.int64)
                for k in range(2, ORDER + 1):
                    i, gram, context, suffix = s.order(k)
                    initial = (s.at[i] == k - 1).astype(np.int64)
                    packed, back = np.unique(((gram << CONTEXT_BITS | context) << GRAM_BITS | suffix) << 1 | initial, return_inverse=True)
                    n = np.bincount(back, often[s.word[i]], len(packed)).astype(np.int64)
                    key = packed >> GRAM_BITS + CONTEXT_BITS + 1, packed >> GRAM_BITS + 1 & (1 << CONTEXT_BITS) - 1, packed >> 1 & (1 << GRAM_BITS) - 1, packed & 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x, np.int32)) for x in (cls, k)] + [pa.array(x.astype(np.int32)) for x in key] + [pa.array(n)], names=["cls", "k", "gram", "context", "suffix", "initial", "n"])

    keys = ("cls", "k", "gram", "context", "suffix", "initial")
    return rows.mapInArrow(run, ", ".join(f"{x} int" for x in keys) + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def discounts(k: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney discount of each order, n1 / (n1 + 2 n2), by the counts of its grams."""
    out = np.full(ORDER + 1, 0.75)
    for order in range(2, ORDER + 1):
        once, twice = (int((counts[k == order] == x).sum()) for x in (1, 2))
        if once and twice:
            out[order] = once / (once + 2 * twice)
    return out


def _packed(counts: pa.Table) -> dict[str, list[tuple[int, np.float32, np.ndarray, np.ndarray]]]:
    """A Model's tables, each as its length, its least value and the places of others with their values."""
    cls, k, gram, context, suffix, initial, n = (counts.column(i).to_numpy() for i in range(7))
    size, contexts = 1 << GRAM_BITS, 1 << CONTEXT_BITS
    out: dict[str, list] = {x: [] for x in ("value", "total", "kept", "discount")}

    def sparse(x: np.ndarray) -> tuple[int, np.float32, np.ndarray, np.ndarray]:
        x = x.astype(np.float32)
        least = x.min()
        at = np.flatnonzero(x != least).astype(np.int32)
        return len(x), least, at, x[at]

    def add(k, gram, context, value) -> None:
        d = discounts(k, value)
        out["value"].append(sparse(np.bincount(gram, value, size)))
        out["total"].append(sparse(np.bincount(context, value, contexts)))
        out["kept"].append(sparse(np.bincount(context, np.maximum(value - d[k], 0), contexts)))
        out["discount"].append(sparse(d))

    for c in (0, 1):
        own = np.flatnonzero((cls == c) & ((k == ORDER) | (initial == 1)))
        add(k[own], gram[own], context[own], n[own])
    # Below, a gram counts by the grams that end with it.
    after = np.zeros(size, np.int32)
    for order in range(2, ORDER + 1):
        own = k == order
        ends = (np.unique(gram[own].astype(np.int64) << GRAM_BITS | suffix[own]) & size - 1).astype(np.int32)
        if order == 2:
            shared = np.bincount(ends, minlength=size) + 0.5
            shared /= shared[shared > 0.5].sum() + 128
            out["shared"] = [sparse(shared)]
            del shared
        else:
            np.add.at(after, ends, 1)
    inner = np.flatnonzero((k < ORDER) & (after[gram] > 0))
    inner = np.unique((k[inner].astype(np.int64) << GRAM_BITS | gram[inner]) << CONTEXT_BITS | context[inner])
    k, gram, context = (x.astype(np.int32) for x in (inner >> GRAM_BITS + CONTEXT_BITS, inner >> CONTEXT_BITS & size - 1, inner & contexts - 1))
    add(k, gram, context, after[gram])
    return out


class Model:
    """Log-ratio of the two classes for words, from dense tables.

    A class has counts of its own for the longest gram that ends at a byte; all that this backs off to is shared: the
    counts of both classes together, by what stands before a gram.
    """

    #: Tables are mostly one value: only places that differ are held till the first use, and travel.
    packed: dict | None = None

    def __init__(self, counts: pa.Table):
        self.packed = _packed(counts)

    def _unpack(self) -> None:
        def dense(size: int, rest: np.float32, at: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = np.full(size, rest, np.float32)
            out[at] = x
            return out

        for k, v in self.packed.items():
            tables = [dense(*x) for x in v]
            setattr(self, k, tables[0] if k == "shared" else tables)
        self.packed = None

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word."""
        if self.packed:
            self._unpack()
        return np.concatenate([np.empty(0), *(self._ratios(words[at : at + PART_WORDS]) for at in range(0, len(words), PART_WORDS))])

    def _ratios(self, words: list[bytes]) -> np.ndarray:
        s = Spelling(words)
        below, own = np.ones(len(s.bytes)), [np.ones(len(s.bytes)) for _ in range(2)]
        for k in range(2, ORDER + 1):
            i, gram, context, suffix = s.order(k)
            if k == 2:
                below[i] = self.shared[suffix]
            last = (s.at[i] == k - 1) | (k == ORDER)
            for c in (0, 1):
                own[c][i[last]] = self._order(c, k, gram[last], context[last], below[i[last]])
            more = ~last  # what is longest here asks for no more of the shared orders
            below[i[more]] = self._order(2, k, gram[more], context[more], below[i[more]])
        logs = [np.add.reduceat(np.log(np.maximum(p, 1e-12)), s.start) for p in own]
        return logs[1] - logs[0]

    def _order(self, table: int, k: int, gram: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
        n = self.total[table][context]
        some = np.maximum(n, 1)
        kept = np.minimum(np.maximum(self.value[table][gram] - self.discount[table][k], 0) / some, 1)
        return kept + np.where(n > 0, np.clip(1 - self.kept[table][context] / some, 0.01, 1), 1) * below


def features(ratios: np.ndarray) -> tuple[float, ...]:
    """Mean log-ratio of the words, of the stretch of STRETCH words where it is largest, and of the single best; mean of what exceeds 3."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    ratios = np.clip(ratios, -3, 8)
    sums = np.cumsum(np.r_[0.0, ratios])
    k = min(STRETCH, n)
    return float(sums[-1] / n), float((sums[k:] - sums[:-k]).max() / STRETCH), float(ratios.max()), float(np.log1p(1000 * np.maximum(ratios - 3, 0).mean()))


N_FEATURES = 4


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with an intercept and a small ridge, by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def train(texts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(broadcast Model, curve) from labelled rows, max_labelled of them at most.

    Rows whose text or label is null teach nothing; a repeated id teaches by its largest label and by
    one of its texts. One row in four goes to the curve, the others to the counts. Without rows of both labels all
    scores are the share of toxic rows (0.5 without any).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("cls"))
    # Bounded by max_labelled rows of an id and a label.
    some = known.select("id", "cls", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_labelled)
    held = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("binary").alias("t"))
    # An id teaches by one of its texts and equal texts teach once, by the first id: max_labelled rows at most, found without moving texts.
    once = held.select("id", "fp").join(F.broadcast(some), "id").groupBy("id", "cls", "h").agg(F.min("fp").alias("fp")).groupBy("fp", "cls").agg(F.min(F.struct("h", "id")).alias("x")).select("fp", "cls", "x.h", "x.id")
    rows = held.join(F.broadcast(once), ["id", "fp"])
    model = texts.sparkSession.sparkContext.broadcast(Model(gram_counts(rows.where("pmod(h, 4) <> 0").select("t", "cls")).toArrow()))  # tables of fixed size
    held = _features(rows.where("pmod(h, 4) = 0").select("cls", "t"), model, "t").select("row.cls", *[f"f{i}" for i in range(N_FEATURES)]).toArrow()
    y, x = held.column(0).to_numpy().astype(float), np.stack([held.column(1 + i).to_numpy() for i in range(N_FEATURES)], 1)
    if 0 < y.sum() < len(y):
        return model, fit_curve(x, y)
    share = (y.sum() + 1) / (len(y) + 2)
    return model, np.array([np.log(share / (1 - share)), *[0.0] * N_FEATURES])


def _features(rows: DataFrame, model: Broadcast, text_col: str) -> DataFrame:
    """Each row of rows as struct `row`, and its features; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f"f{i}" for i in range(N_FEATURES)]
    at, kind = rows.columns.index(text_col), rows.schema
    schema = T.StructType([T.StructField("row", kind), *(T.StructField(x, T.DoubleType()) for x in names)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            f = []
            for part in _parts(batch, batch.column(0).field(at), 256):
                texts = [words_of(t) for t in part.column(0).field(at).cast(pa.binary()).to_pylist()]
                known = list(set().union(*texts))
                ratio = dict(zip(known, m.ratios(known).tolist(), strict=True))
                f += [features(np.fromiter(map(ratio.__getitem__, t), np.float64, len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), *(pa.array([x[i] for x in f], pa.float64()) for i in range(N_FEATURES))], names=["row", *names])

    return rows.select(F.struct(*rows.columns).alias("row")).mapInArrow(run, schema)


def scored(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Each row of docs as struct `row`, whatever its columns are named, and its score double."""
    model, curve = train(training, labels, max_labelled, id_col, text_col, label_col)
    z = sum((F.lit(float(w)) * F.col(f"f{i}") for i, w in enumerate(curve[1:])), F.lit(float(curve[0])))
    return _features(docs, model, text_col).select("row", (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """<id_col> and score double (0 to 1, higher: likelier toxic) of each row of docs.

    Learns from the rows of labels and their texts in training; ids only join the two. Null and
    empty texts score as a text that says nothing for either class. Null ids and repeated rows keep
    their rows. Other columns are ignored.
    """
    s = scored(docs.select(id_col, text_col), training, labels, id_col, text_col, label_col, max_labelled)
    return s.select(F.col("row")[id_col].alias(id_col), "score")


def without_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the rows that score threshold or more; each row is judged by its own text, clean rows stay as they are."""
    return scored(docs, training, labels, **options).where(F.col("score") < threshold).select("row.*")
