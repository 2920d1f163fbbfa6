"""Best-fit packing of tokenised documents into fixed-length training sequences.

Bounded-space online best fit: every task keeps a fixed number of open bins. A bitset (one
Python integer) has bit f set while some open bin has f free places, so the tightest bin that
fits is one shift and one lowest-set-bit away. When a bin must make room, the fullest closes.
What is still open when a task ends is packed again, many tasks together, longest first.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Words kept in each of the two generations of a worker's token cache.
CACHE_WORDS = 250_000
#: What a vocabulary's tokens at the end of a run of letters end with.
END_MARK = "</w>"
#: Tasks whose leftovers are packed together in the second round.
MERGE_TASKS = 64


class WordTokenizer:
    """Token ids of whole texts, by way of a bounded cache of words.

    Where a tokenizer never joins characters across a blank or a line end, nor a letter with the
    full stops and commas after it, and lower-cases, a text's ids are its words' ids in order. A
    tokenizer that a few probes show to be of another kind encodes whole texts.
    """

    PROBES = ("Hello, World. It's  a test\nnew line\n\nA.B. x,y.. 3.14 ...", "\u00c9t\u00e9 na\u00efve \u0130 \u00df \u4f60\u597d, ok. <|end|> [x] #1", " lead and trail ", "UPPER lower MiXed,", "")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that normalising leaves as they are and no pattern splits: the same model without both.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_MARK)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_word = bool(self.ends.any()) and self._by_words(list(self.PROBES), b"") == self._whole(list(self.PROBES), b"")

    def _normal(self, word: str) -> str:
        return self.tokenizer.normalizer.normalize_str(word) if self.tokenizer.normalizer else word

    def texts(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, followed by the end id."""
        return (self._by_words if self.by_word else self._whole)(texts, end)

    def _whole(self, texts: list[str | None], end: bytes) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() + end for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def _encode(self, words: list[str]) -> None:
        """Words of lower-case letters alone are one run each, which ends at the one id with an end mark: many go in one text."""
        plain = [w for w in words if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)]
        self._encode_each(list(set(words).difference(plain)))
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cut) != len(part) + 1:
                self._encode_each(part)
                continue
            raw = ids.tobytes()
            for w, a, b in zip(part, cut, cut[1:]):
                self.young[w] = raw[a:b]

    def _encode_each(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, "<u4").tobytes()

    def _by_words(self, texts: list[str | None], end: bytes) -> list[bytes]:
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        unseen = set().union(*split).difference(young)
        for w in old.keys() & unseen:  # looks up the smaller side; intersection() would walk all of old
            young[w] = old[w]
        todo, built = set(), []
        for w in unseen.difference(old):
            core = w.rstrip(".,")
            if not core or not core[-1].isalpha() or not core.isascii() and not self._normal(core)[-1:].isalpha():
                core = w  # what normalising leaves at the end may join what follows, as a combining mark does
            low = core.lower() if core.isascii() and "<|" not in core else core
            todo.add(low)
            if low != w:
                built.append((w, low, w[len(core) :]))
        todo.update({tail for _, _, tail in built})
        self._encode(list(todo.difference(young)))
        for w, core, tail in built:
            young[w] = young[core] + young[tail]
        return [b"".join([*map(young.__getitem__, s), end]) for s in split]


class BestFit:
    """Open bins keyed by free space."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.bits = 0
        self.by_free: dict[int, list[tuple[int, list]]] = {}
        self.n_open = 0

    def _take(self, free: int) -> tuple[int, list]:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def add(self, length: int, item) -> Iterator[tuple[int, list]]:
        """Place an item of 1 to capacity places; yields the bins that close, as (id, items)."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name, items = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            free, name, items = self.capacity, self.next_id, []
            self.next_id += 1
        items.append(item)
        free -= length
        if free == 0:
            yield name, items
            return
        self.by_free.setdefault(free, []).append((name, items))
        self.bits |= 1 << free
        self.n_open += 1

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def _rows(closed: list[tuple[int | None, list]], schema: pa.Schema) -> pa.RecordBatch:
    """Items are (doc_id, piece, start, length, ids); places in a sequence follow item order."""
    cols: list[list] = [[] for _ in schema]
    for name, items in closed:
        at = 0
        for doc, piece, start, length, ids in items:
            for c, v in zip(cols, (doc, piece, start, length, ids, name, None if name is None else at, None), strict=True):
                c.append(v)
            at += length
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, open_bins: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most max_tokens ids.

    Returns a row per piece: <id_col>, piece int, start long, length long, ids binary (unsigned
    little-endian 32-bit), sequence_id long, offset long. A document is its ids followed by
    end_id; only longer ones are cut. Null and empty texts are the end id alone. Repeated rows
    and null ids are documents of their own. No rows in, no rows out. Other columns of docs are
    ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("task", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tok, bins, done, size = _tokenizer(tokenizer_path), BestFit(max_tokens, open_bins, task << 32), [], 0

        def out(done):
            b = _rows(done, arrow)
            return b.set_column(7, arrow.field(7), pa.array([task] * b.num_rows, pa.int64()))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), tok.texts(part.column(1).to_pylist(), end), strict=True):
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, max_tokens)):
                        length = min(max_tokens, n - start)
                        for closed in bins.add(length, (doc, piece, start, length, ids[4 * start : 4 * (start + length)])):
                            done.append(closed)
                            size += max_tokens
                if size > 1 << 20:
                    yield out(done)
                    done, size = [], 0
        yield out(done)
        yield out([(None, items) for _, items in bins.rest()])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, bins, names = None, None, (1 << 62) | (part << 32)
        for batch in batches:
            done = []
            rows = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7)]
            for doc, piece, start, length, ids, task in zip(*rows, strict=True):
                if task // MERGE_TASKS != group:
                    if bins:
                        done += bins.rest()
                        names = bins.next_id
                    group, bins = task // MERGE_TASKS, BestFit(max_tokens, open_bins * MERGE_TASKS, names)
                done += bins.add(length, (doc, piece, start, length, ids))
            yield _rows(done, arrow)
        if bins:
            yield _rows(list(bins.rest()), arrow)

    once = written(docs.select(id_col, text_col).mapInArrow(first, schema), "packed")
    closed = once.where(F.col("sequence_id").isNotNull())
    group = F.floor(F.col("task") / MERGE_TASKS)
    # The leftovers of MERGE_TASKS tasks: at most that many times open_bins short sequences.
    open_rows = once.where(F.col("sequence_id").isNull()).repartition(group).sortWithinPartitions(group, F.desc("length"), id_col, "piece")
    return closed.unionByName(open_rows.mapInArrow(second, schema)).drop("task")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, which Spark reuses for later tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
