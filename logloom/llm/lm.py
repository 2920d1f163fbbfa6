"""Language-model scoring with a log-frequency Bloom filter.

Counting: map tasks send packed, sorted n-gram counts to segments by the hash of the history, so
that all that follows a word meets in one task. Each segment keeps the pairs seen often enough and
builds its own part of the filter: a pair of quantised level q goes in with the levels 1 to q, and
each history with the quantised mass of its kept pairs and of what was left out. Probing levels
until one is missing gives a count back.

Scoring: P(w|h) = (kept(h, w) + left(h) * P(w)) / (all_kept(h) + left(h)), which sums to at most
one; P(w) is the exact add-0.1 unigram estimate, which also stands alone where a history is unknown.

All pairs seen LEAST times or more are kept, however large the input; the number of segments grows
with the text. A filter and word counts of up to MAX_BROADCAST bytes together are broadcast: every
Python worker has a copy of its own. Beyond that the distinct pairs of each block of documents go to
the segments of their histories, which send back levels and the exact counts of the histories. (A
word is the history of what follows it, so each word's count comes back with the next word's pair.)
Neither a segment's filter nor its counts then leave the task that holds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, written

#: Least count of a kept pair.
LEAST = 2
#: A filter and exact word counts (16 bytes each) of up to so many bytes are broadcast.
MAX_BROADCAST = 8 << 20
#: Bytes of training text for each segment, about.
SEGMENT_BYTES = 4 << 20
#: About one false positive in 10,000 probes while the filter has room.
BITS_PER_ENTRY, PROBES = 20, 10
#: Bytes of training text whose segments one task works through, one after the other.
TASK_BYTES = 256 << 20
#: Words that a map task gathers before it sends counts.
FLUSH = 4_000_000
#: Words of a block of documents whose pairs are sent to segments together.
BLOCK = 1_000_000
#: Pairs that a segment looks up together.
ANSWER = 500_000
LEVELS = 64

END = np.uint64(xxhash.xxh3_64_intdigest(b"\n</s>"))
START = np.uint64(xxhash.xxh3_64_intdigest(b"\n<s>"))
PAIR, KEPT, LEFT = (np.uint64(x) for x in (0x51ED270B, 0x2545F491, 0x6C8E9CF5))


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, then the end token."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pairs(t: np.ndarray) -> np.ndarray:
    """Upper halves of the hashes of history and word."""
    before = np.r_[START, t[:-1]]
    return (before & np.uint64(0xFFFFFFFF00000000)) | (t >> np.uint64(32))


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def by_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, stop) of the runs of sorted keys; segments without keys cost nothing."""
    s = segment_of(keys, segments).astype(np.int64)
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    return zip(s[start].tolist(), start.tolist(), [*start[1:].tolist(), len(s)][: len(start)], strict=True)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.add.reduceat(counts, start)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted pairs as histories, their numbers of words, words, and counts (one byte each if all are 1 to 255)."""
    h = (keys >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    c = b"" if len(counts) and counts.max() == 1 else counts.astype(np.uint32).tobytes()  # of a few texts, so of less than 2**32 words
    return h[start].tobytes(), np.diff(np.r_[start, len(h)]).astype(np.uint32).tobytes(), keys.astype(np.uint32).tobytes(), c


def _unpacked(h: bytes, n: bytes, w: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(w, np.uint32).astype(np.uint64)
    keys = (np.repeat(np.frombuffer(h, np.uint32), np.frombuffer(n, np.uint32)).astype(np.uint64) << np.uint64(32)) | words
    return keys, np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(words), np.int64)


# kind 0: word counts as keys and counts; kind 1: pairs seen once; kind 2: pairs seen more often
SENT = "segment int, kind int, a binary, b binary, c binary, d binary"


def gram_counts(texts: DataFrame, segments: int) -> DataFrame:
    """Packed counts by segment of a single column t, binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send():
            rows = []
            words, n = np.unique(np.concatenate(held), return_counts=True)
            for s, a, b in by_segment(words, segments):
                rows.append((s, 0, words[a:b].tobytes(), n[a:b].astype(np.int64).tobytes(), b"", b""))
            both, n = np.unique(np.concatenate([pairs(t) for t in held]), return_counts=True)
            for kind, m in ((1, n == 1), (2, n > 1)):
                keys, counts = both[m], n[m]
                for s, a, b in by_segment(keys, segments):
                    rows.append((s, kind, *_packed(keys[a:b], counts[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["segment", "kind", "a", "b", "c", "d"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    held.append(tokens(text))
                    size += len(held[-1])
                if size > FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return texts.mapInArrow(run, SENT)


MERGED = "segment int, words binary, word_counts binary, n long, v long, keys binary, counts binary, histories binary, types binary, once binary, bits long"


def merged_counts(sent: DataFrame, tasks: int) -> DataFrame:
    """One row a segment: word counts; pairs seen twice or more; of each history its kinds of words and its pairs seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, words, both = None, [], []

        def out():
            w, n = summed(*(np.concatenate(x) for x in zip(*words, strict=True))) if words else (np.empty(0, np.uint64), np.empty(0, np.int64))
            k, c = summed(*(np.concatenate(x) for x in zip(*both, strict=True)))
            h = (k >> np.uint64(32)).astype(np.uint32)
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            types, once = np.diff(np.r_[start, len(h)]), np.add.reduceat((c == 1).astype(np.int64), start)
            some, often = once < types, c > 1
            kept = k[often], c[often], h[start][some], types[some], once[some]
            row = (segment, w.tobytes(), n.tobytes(), int(n.sum()), len(w), *(x.tobytes() for x in kept), bits_for(entries(*kept, LEAST)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MERGED.split(", ")])

        for batch in batches:
            for s, kind, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if s != segment:
                    if both:
                        yield out()
                    segment, words, both = s, [], []
                if kind:
                    both.append(_unpacked(a, b, c, d))
                else:
                    words.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
        if both or words:
            if not both:
                both.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            yield out()

    return sent.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(run, MERGED)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(kind: np.uint64, keys: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    h = _mix(keys ^ np.uint64(int(kind) * 0x9E3779B97F4A7C15 % 2**64) ^ (np.asarray(level).astype(np.uint64) << np.uint64(56)))
    return h + np.uint64(probe) * (_mix(h) | np.uint64(1))


def count_level(c: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log2(c / least)).astype(np.int64)


def count_value(level: np.ndarray, least: int) -> np.ndarray:
    return np.where(level > 0, least * 2.0 ** (level - 1), 0.0)


def mass_level(x: np.ndarray) -> np.ndarray:
    """Rounded up, in steps of the square root of two."""
    return 1 + np.ceil(2 * np.log2(np.maximum(x, 1)) - 1e-9).astype(np.int64)


def mass_value(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - 1) / 2), 0.0)


def entries(keys: np.ndarray, counts: np.ndarray, histories: np.ndarray, types: np.ndarray, once: np.ndarray, least: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """(kind, keys, levels) that a segment's filter holds if pairs seen `least` times or more are kept."""
    at = np.searchsorted(histories, (keys >> np.uint64(32)).astype(np.uint32))
    stays = counts >= least
    level = count_level(np.maximum(counts, least), least)
    kept = np.bincount(at, np.where(stays, count_value(level, least), 0.0), len(histories))
    left = types + once + np.bincount(at, np.where(stays, 0, counts), len(histories))
    known = kept > 0
    of_history = histories[known].astype(np.uint64) << np.uint64(32)
    return [(PAIR, keys[stays], level[stays]), (KEPT, of_history, mass_level(kept[known])), (LEFT, of_history, mass_level(left[known]))]


def bits_for(items: list[tuple[np.uint64, np.ndarray, np.ndarray]]) -> int:
    """Bits of a segment: a power of two, or none for no entries."""
    n = BITS_PER_ENTRY * sum(int(x.sum()) for _, _, x in items)
    return 1 << max(6, (n - 1).bit_length()) if n else 0


def segment_bits(items: list[tuple[np.uint64, np.ndarray, np.ndarray]]) -> bytes:
    bits = bits_for(items)
    held = np.zeros(bits, np.uint8)
    for kind, k, levels in items:
        for j in range(1, int(levels.max(initial=0)) + 1):
            m = levels >= j
            for p in range(PROBES):
                held[(_places(kind, k[m], j, p) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held).tobytes()


@dataclass
class Filter:
    """Segments one after another; sizes in bits."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    least: int

    def levels(self, kind: np.uint64, keys: np.ndarray) -> np.ndarray:
        """Highest level up to which all levels of each key are in."""
        out = np.zeros(len(keys), np.int64)
        s = segment_of(keys, len(self.size)).astype(np.int64)
        on = np.flatnonzero(self.size[s] > 0)
        keys, start, mask = keys[on], self.start[s[on]], (self.size[s[on]] - 1).astype(np.uint64)
        for j in range(1, 2 * LEVELS):
            for p in range(PROBES):  # most keys that are not in leave after a probe or two
                at = (_places(kind, keys, j, p) & mask).astype(np.int64)
                there = (self.bits[start + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                on, keys, start, mask = on[there], keys[there], start[there], mask[there]
            out[on] = j
            if not len(on):
                break
        return out


def pair_levels(pair: np.ndarray, f: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct pairs: their level and their history's place; of each history its two levels."""
    history, at = np.unique(pair >> np.uint64(32), return_inverse=True)
    history = history << np.uint64(32)
    kept, left, level = f.levels(KEPT, history), np.zeros(len(history), np.int64), np.zeros(len(pair), np.int64)
    known = np.flatnonzero(kept)
    left[known] = f.levels(LEFT, history[known])
    m = np.flatnonzero(kept[at])
    level[m] = f.levels(PAIR, pair[m])
    return level, at, kept, left


def base_probability(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return (c + 0.1) / (n + 0.1 * (v + 1))


def model_probability(base: np.ndarray, c: np.ndarray, level: np.ndarray, kept: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """By base probability, exact training count, and levels of the pair and of its history."""
    model = base.copy()
    m = np.flatnonzero(kept)
    of_kept, of_left = mass_value(kept[m]), np.maximum(mass_value(left[m]), 1.0)
    got = np.minimum(count_value(level[m], least), of_kept)
    got = np.where(c[m] >= least, np.minimum(got, c[m]), 0)  # a pair is never more frequent than its word
    model[m] = (got + of_left * base[m]) / (of_kept + of_left)
    return model


def score_pairs(key: np.ndarray, c: np.ndarray, n: int, v: int, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base probability and of the model's, of tokens by their pair and exact training count."""
    base = base_probability(c, n, v)
    pair, of = np.unique(key, return_inverse=True)
    level, at, kept, left = pair_levels(pair, f)
    return np.log10(base), np.log10(model_probability(base, c, level[of], kept[at[of]], left[at[of]], f.least))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as the least runs of bytes that hold them, each number's bytes apart, which compress better; a byte says how many."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<i8").ravel()


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


# Of a segment: its filter, its words and their counts (block null; a, b, c), or a block's pairs (histories,
# their numbers of words, halves of the words' hashes). What comes back: levels of the pairs; kept mass, left
# mass and count of the histories (a, b, c, d). Of a block (segment -1): places of its words' pairs, where
# the history changes, words of each document (a, b, c), and ids.
ASKED = "segment int, block long, a binary, b binary, c binary, d binary"
_ASKED = (("segment", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcd"))


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _ASKED, strict=True)], names=[n for n, _ in _ASKED])


class Block:
    """Documents whose pairs are asked for together."""

    def __init__(self, ids: pa.Array, texts: list[np.ndarray], place: bytes):
        history = np.concatenate([np.r_[START, t[:-1]] for t in texts])
        word = np.concatenate(texts) >> np.uint64(32)
        order = np.lexsort((word, history))
        h, w = history[order], word[order]
        self.new_history = np.r_[True, h[1:] != h[:-1]]
        new = self.new_history | np.r_[True, w[1:] != w[:-1]]
        self.at = np.empty(len(h), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.history, self.word, self.new_history = h[new], w[new].astype(np.uint32), self.new_history[new]
        self.ids, self.words = ids, np.array([len(t) for t in texts], np.int64)
        # Rows read in another order make other blocks, whose parts never meet: an error, not a wrong score.
        self.name = xxhash.xxh3_64_intdigest(place + history.tobytes() + repr(ids.to_pylist()).encode()) - 2**63

    def pairs(self, segments: int) -> Iterator[tuple]:
        start = np.flatnonzero(self.new_history)
        n = np.diff(np.r_[start, len(self.history)]).astype(np.uint32)
        first = self.history[start]
        ends = np.r_[start, len(self.history)]
        for s, a, b in by_segment(first, segments):
            yield s, self.name, first[a:b].tobytes(), n[a:b].tobytes(), self.word[ends[a] : ends[b]].tobytes(), None

    def row(self) -> tuple:
        return -1, self.name, _planes(self.at), np.packbits(self.new_history).tobytes(), self.words.tobytes(), None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    task, no = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            new = [tokens(t) for t in part.column(1).to_pylist()]
            ids.append(part.column(0))
            texts += new
            size += sum(map(len, new))
            if size > BLOCK:
                yield Block(pa.concat_arrays(ids), texts, b"%d %d " % (task, no))
                ids, texts, size, no = [], [], 0, no + 1
    if texts:
        yield Block(pa.concat_arrays(ids), texts, b"%d %d " % (task, no))


class Segment:
    """What a segment knows: its part of the filter, and the counts of its words."""

    def __init__(self, bits: bytes, words: bytes, counts: bytes):
        self.filter = Filter(np.frombuffer(bits or b"\0", np.uint8), np.array([0]), np.array([8 * len(bits)]), LEAST)
        words, counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def count(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels and counts for each (segment, block). A segment's own row comes first."""
    segment, known = None, None
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def answers() -> pa.RecordBatch:
        pair, of = np.unique(np.concatenate([p for _, _, p in held]), return_inverse=True)
        level, at, kept, left = pair_levels(pair, known.filter)
        rows, first = [], 0
        for block, histories, p in held:
            mine, h = of[first : first + len(p)], p >> np.uint64(32)
            # Histories in a row of one half hash share their levels.
            place = at[mine[np.searchsorted(h, histories >> np.uint64(32))]]
            rows.append((segment, block, *(y.astype(np.uint8).tobytes() for y in (level[mine], kept[place], left[place])), _planes(known.count(histories))))
            first += len(p)
        return _asked(rows)

    for batch in batches:
        for s, block, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (s != segment or size > ANSWER):
                yield answers()
                held, size = [], 0
            if s != segment:
                segment, known = s, Segment(b"", b"", b"")
            if block is None:
                known = Segment(*x[:3])
                continue
            histories, n = np.frombuffer(x[0], np.uint64), np.frombuffer(x[1], np.uint32)
            held.append((block, histories, np.repeat(histories & np.uint64(0xFFFFFFFF00000000), n) | np.frombuffer(x[2], np.uint32)))
            size += len(held[-1][2])
    if held:
        yield answers()


def _block_scores(of_block: tuple, answers: list[tuple], n: int, v: int, texts: int) -> tuple[np.ndarray, ...]:
    """Words, known words, base and model score of each document of a block; texts: training texts, as many as end tokens."""
    at, words = _from_planes(of_block[0]), np.frombuffer(of_block[2], np.int64)
    level, kept, left = (np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in list(zip(*answers, strict=True))[:3])
    count = np.concatenate([_from_planes(x[3]) for x in answers])
    history = np.cumsum(_bits(of_block[1], len(level))) - 1
    if len(level) != at.max() + 1 or not len(kept) == len(count) == history[-1] + 1:
        raise RuntimeError("a block's pairs came back incomplete")
    of = history[at]
    last = np.cumsum(words) - 1
    c = np.r_[count[of[1:]], 0]  # a word's own count is that of the next word's history
    c[last] = texts
    base = base_probability(c, n, v)
    model = np.log10(model_probability(base, c, level[at], kept[of], left[of], LEAST))
    start = np.r_[0, last[:-1] + 1]
    return words, np.add.reduceat((c > 0).astype(np.int64), start), np.add.reduceat(np.log10(base), start), np.add.reduceat(model, start)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST, stable: bool = False) -> DataFrame:
    """Base and model log10 probability of each text, learnt from the rows where `training` holds.

    Returns <id_col>, n_tokens, n_known, train_tokens (long), base_score, score (double). Null and
    empty texts are the end token alone. Null ids and repeated rows keep their rows, and train if
    `training` says so; a null there is no. Without training rows each token has probability one of
    one. Other columns are ignored. docs is read more than once: unless it is `stable`, a table that
    always gives the same rows in the same order, it is written out first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("t"), F.coalesce(training, F.lit(False)).alias("learn"))
    if not stable:
        rows = written(rows, "texts")
    learnt = rows.where("learn")
    texts, size = (x or 0 for x in learnt.agg(F.count("*"), F.sum(F.octet_length("t"))).first())
    segments = max(64, shuffle_partitions(spark), size // SEGMENT_BYTES)
    tasks = min(segments, max(64, 4 * shuffle_partitions(spark), size // TASK_BYTES))
    merged = written(merged_counts(gram_counts(learnt.select("t"), segments), tasks), "grams")
    n, v, bits = (x or 0 for x in merged.agg(F.sum("n"), F.sum("v"), F.sum("bits")).first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, w, c, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = [np.frombuffer(b, t) for b, t in zip(x, (np.uint64, np.int64, np.uint32, np.int64, np.int64), strict=True)]
                yield _asked([(s, None, segment_bits(entries(*arrays, LEAST)), w, c, None)])

    built = merged.select("segment", "words", "word_counts", "keys", "counts", "histories", "types", "once").mapInArrow(build, ASKED)
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    arrow = list(to_arrow_schema(schema))

    def scores(ids: pa.Array, words, known, base, model) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip((words, known, np.full(len(words), n), base, model), arrow[1:], strict=True))], names=schema.names)

    if bits // 8 + 16 * v <= max_broadcast:
        out = _by_broadcast(rows.select("id", "t"), built, segments, n, v, schema, scores)
    else:
        out = _by_segments(rows.select("id", "t"), built, segments, tasks, n, v, texts, schema, scores)
    return out.withColumnRenamed("id", id_col)


def _by_broadcast(rows: DataFrame, built: DataFrame, segments: int, n: int, v: int, schema: T.StructType, scores) -> DataFrame:
    got = {r.segment: r for r in built.collect()}  # max_broadcast bytes at most
    parts = [bytes(got[s].a) if s in got else b"" for s in range(segments)]
    size = np.array([8 * len(x) for x in parts], np.int64)
    all_words = [np.frombuffer(r.b, np.uint64) for r in got.values()]
    all_counts = [np.frombuffer(r.c, np.int64) for r in got.values()]
    known = Segment(b"", b"".join(x.tobytes() for x in all_words), b"".join(x.tobytes() for x in all_counts))
    held = rows.sparkSession.sparkContext.broadcast((Filter(np.frombuffer(b"".join(parts) or b"\0", np.uint8), np.r_[0, np.cumsum(size)[:-1]] // 8, size, LEAST), known))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [tokens(t) for t in part.column(1).to_pylist()]
                words = np.array([len(t) for t in texts])
                start = np.r_[0, np.cumsum(words)[:-1]]
                filter_, counts = held.value
                c = counts.count(np.concatenate(texts))
                base, model = score_pairs(np.concatenate([pairs(t) for t in texts]), c, n, v, filter_)
                yield scores(part.column(0), words, np.add.reduceat((c > 0).astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(model, start))

    return rows.mapInArrow(scored, schema)


def _by_segments(rows: DataFrame, built: DataFrame, segments: int, tasks: int, n: int, v: int, texts: int, schema: T.StructType, scores) -> DataFrame:
    """Scores by way of the segments; nothing but one segment and a few blocks' pairs, or one block, is in memory."""
    kind = schema["id"].dataType
    with_ids = T.StructType([*T._parse_datatype_string(ASKED).fields, T.StructField("ids", T.ArrayType(kind))])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _asked(list(block.pairs(segments)))

    def themselves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids = pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids)
            yield pa.RecordBatch.from_arrays([*_asked([block.row()]).columns, ids], names=with_ids.names)

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ids = of_block = None
        answers: list[tuple] = []

        def out():
            if of_block is None or not answers:
                raise RuntimeError("a block's rows came in another order when read again")
            return scores(ids, *_block_scores(of_block, answers, n, v, texts))

        for batch in batches:
            for i in range(batch.num_rows):
                s, b, *x = (c[i].as_py() for c in batch.columns[:6])
                if b != block:
                    if block is not None:
                        yield out()
                    block, of_block, answers = b, None, []
                if s == -1:
                    of_block, ids = x, batch.column(6).slice(i, 1).flatten()
                else:
                    answers.append(tuple(x))
        if block is not None:
            yield out()

    # Both ways read rows alike, first in their unions, so that tasks and blocks have the same numbers.
    asked = rows.mapInArrow(asks, ASKED).unionByName(built)
    back = asked.repartition(tasks, "segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first()).mapInArrow(_answered, ASKED)
    both = rows.mapInArrow(themselves, with_ids).unionByName(back.withColumn("ids", F.lit(None).cast(T.ArrayType(kind))))
    return both.repartition(tasks, "block").sortWithinPartitions("block", "segment").mapInArrow(summed_up, schema)
