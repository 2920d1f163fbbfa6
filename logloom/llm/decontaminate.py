"""Benchmark decontamination: test items are looked up in suffix arrays over the training documents.

Documents are cut into shards of bounded bytes inside Arrow batches. A shard's words become numbers
of the benchmark's vocabulary (64-bit hashes, and words that end up in a match are compared byte by
byte); runs of known words that are too short for any match are left out, and the suffixes of the
rest are sorted by prefix doubling. Binary search then finds every test suffix: the longest match
stands at its place in the order, and all occurrences of its window are one range. Documents are not
shuffled. The benchmark is broadcast in blocks of bounded bytes, one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a shard, about (a longer text is one alone), in a block of test items, and in a piece that is hashed at a time.
SHARD_BYTES, BLOCK_BYTES, HASH_BYTES = 8 << 20, 4 << 20, 1 << 20

_BYTE = np.arange(256, dtype=np.uint8)
#: A word's bytes, A-Z lower-cased; 0 for all that parts words.
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, np.where((_BYTE >= 48) & (_BYTE <= 57) | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128), _BYTE, 0)).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base & (2**64 - 1), np.uint64))])


@dataclass
class Words:
    """Words of some texts: 64-bit hash, bounds in `folded`, and the text that each is of."""

    folded: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """Words of an array of strings, a null counting as an empty one."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, folded = offsets - offsets[0], _FOLD[data]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(folded))]  # words end with their text
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hash_ = np.empty(len(start), np.uint64)
    at = 0
    up = down = np.ones(1, np.uint64)
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASH_BYTES, "right")))
        a, b = start[at], end[to - 1]
        if len(up) <= b - a:
            up, down = _powers(_BASE, int(b - a) + 1), _powers(pow(_BASE, -1, 2**64), int(b - a) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded[a:b] * up[: b - a])])
        hash_[at:to] = (sums[end[at:to] - a] - sums[start[at:to] - a]) * down[start[at:to] - a]
        at = to
    hash_ = (hash_ ^ (hash_ >> np.uint64(32))) * _MIX
    return Words(folded, hash_, start, end, np.searchsorted(offsets, start, "right") - 1)


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of x in the order of what follows them, at least as far as `depth` numbers; x >= 0, and a number beyond the end is 0."""
    n = len(x)
    rank, done = x.astype(np.int64), 1
    order = np.argsort(rank)
    while True:
        sorted_ = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, sorted_[1:] != sorted_[:-1]]) if n else 0
        if done >= depth or not n or new[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - done, 0)] = new[done:]
        rank, done = new * (n + 1) + after, 2 * done
        order = np.argsort(rank)


@dataclass
class Block:
    """Test items of a block: their words as numbers from 1, a 0 after each item; windows that are equal are one."""

    vocabulary: np.ndarray  # sorted hashes; word i + 1 has hash i
    words: list[bytes]
    maybe: np.ndarray  # whether any hash begins with these bits
    x: np.ndarray
    item_of: np.ndarray  # item of each place of x
    item_at: np.ndarray  # first place of each item
    names: list[str]
    starts: np.ndarray  # of all windows: place, width, number of the window that it equals
    width: np.ndarray
    window: np.ndarray
    at: np.ndarray  # of distinct windows: place, width, and their items
    wide: np.ndarray
    items_from: np.ndarray
    items: np.ndarray
    depth: int

    def numbers(self, hash_: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for one that no item has."""
        out = np.zeros(len(hash_), np.int32)
        some = np.flatnonzero(self.maybe[(hash_ >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hash_[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hash_[some]
        out[some[same]] = at[same] + 1
        return out


def build(ids: list[str | None], texts: pa.Array, window: int) -> Block | None:
    """A block of test items; None if they have no words."""
    w = split_words(texts)
    if not len(w.start):
        return None
    vocabulary, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    words = [w.folded[w.start[i] : w.end[i]].tobytes() for i in first]
    if len(set(words)) < len(words) or any(w.folded[s:e].tobytes() != words[k] for s, e, k in zip(w.start, w.end, number, strict=True)):
        raise RuntimeError("two words of the benchmark have one hash")
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    filled, sizes = np.unique(w.text, return_counts=True)
    place = np.arange(len(w.text)) + np.repeat(np.arange(len(filled)), sizes)
    x = np.zeros(len(w.text) + len(filled), np.int32)
    x[place] = number + 1
    item_at = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    names = ["" if ids[i] is None else str(ids[i]) for i in filled]
    item_of = np.repeat(np.arange(len(filled)), sizes + 1)
    widths = np.minimum(sizes, window)
    of = np.repeat(np.arange(len(filled)), sizes - widths + 1)
    starts = np.concatenate([np.arange(a, a + n - k + 1) for a, n, k in zip(item_at, sizes, widths, strict=True)])
    width, number_of, at, wide = widths[of], np.empty(len(starts), np.int64), [], []
    for k in np.unique(width):
        own = np.flatnonzero(width == k)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, k)[starts[own]]).view(f"V{4 * k}").ravel()
        _, one, same = np.unique(rows, return_index=True, return_inverse=True)
        number_of[own] = sum(map(len, at)) + same.ravel()
        at.append(starts[own[one]])
        wide.append(np.full(len(one), k))
    at, wide = np.concatenate(at), np.concatenate(wide)
    pairs = np.unique(number_of * len(names) + of)
    items_from = np.searchsorted(pairs, np.arange(len(at) + 1) * len(names))
    return Block(vocabulary, words, maybe, x, item_of, item_at, names, starts, width, number_of, at, wide, items_from, pairs % len(names), int(sizes.max()))


def _compare(x: np.ndarray, at: np.ndarray, y: np.ndarray, place: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order (-1, 0, 1) of x from `at` against y from `place` over `width` numbers, and how many agree; x ends with a 0, y has none within width."""
    order, same = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live, d = np.flatnonzero(width > 0), 0
    while len(live):
        a, b = x[at[live] + d], y[place[live] + d]
        order[live] = np.sign(a - b)
        live, d = live[a == b], d + 1
        same[live] = d
        live = live[width[live] > d]
    return order, same


def _search(x: np.ndarray, sa: np.ndarray, b: Block, at: np.ndarray, width: np.ndarray, lo: np.ndarray, after: bool) -> np.ndarray:
    """By binary search, the first suffix from lo on that isn't below the pattern (after: that is above it)."""
    lo, hi = lo.copy(), np.full(len(at), len(sa))
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        order, _ = _compare(x, sa[mid], b.x, at[live], width[live])
        below = order <= 0 if after else order < 0
        lo[live[below]], hi[live[~below]] = mid[below] + 1, mid[~below]
    return lo


@dataclass
class Shard:
    """A shard's known words as numbers, a 0 between runs, with the word each stands for, and the sorted suffixes that can hold a match."""

    x: np.ndarray
    word: np.ndarray
    sa: np.ndarray

    @classmethod
    def of(cls, w: Words, b: Block, number: np.ndarray) -> Shard:
        known = number > 0
        fresh = known.copy()
        fresh[1:] &= ~known[:-1] | (w.text[1:] != w.text[:-1])
        run = np.cumsum(fresh)[known]
        sizes = np.bincount(run, minlength=1)[1:]
        least = int(b.wide.min())
        word = np.flatnonzero(known)
        long_ = (sizes >= least)[run - 1] if len(run) else np.zeros(0, bool)
        word, sizes = word[long_], sizes[sizes >= least]
        place = np.arange(len(word)) + np.repeat(np.arange(len(sizes)), sizes)
        x = np.zeros(len(word) + len(sizes) + 1, np.int32)
        x[place] = number[word]
        back = np.full(len(x), -1)
        back[place] = word
        left = np.zeros(len(x), np.int64)  # words from here to the run's end
        left[place] = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
        sa = suffix_array(x, b.depth)
        return cls(x, back, sa[left[sa] >= least])


@dataclass
class Found:
    hit: np.ndarray  # words within an occurrence of a window
    doc_item: np.ndarray  # text * items + item, distinct
    suffix: np.ndarray  # windows' places that occur: place in the block, length of the longest match, its first word
    length: np.ndarray
    word: np.ndarray


def find(w: Words, b: Block, longest: bool) -> Found:
    number = b.numbers(w.hash)
    while True:
        s = Shard.of(w, b, number)
        there = np.zeros(len(b.vocabulary) + 1, bool)
        there[s.x] = True
        some = np.flatnonzero(there[b.x[b.at]] & there[b.x[b.at + b.wide - 1]])
        at, wide = b.at[some], b.wide[some]
        lo = _search(s.x, s.sa, b, at, wide, np.zeros(len(at), np.int64), False)
        hi = _search(s.x, s.sa, b, at, wide, lo, True)
        found = hi > lo
        some, lo, hi = some[found], lo[found], hi[found]
        n = hi - lo
        which = np.repeat(np.arange(len(some)), n)
        word = s.word[s.sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        size = len(number) + 1
        hit = np.cumsum(np.bincount(word, minlength=size) - np.bincount(word + b.wide[some][which], minlength=size))[:-1] > 0
        words = np.flatnonzero(hit)
        folded = w.folded.tobytes() if len(words) else b""
        wrong = [i for i, a, e, k in zip(words.tolist(), w.start[words].tolist(), w.end[words].tolist(), number[words].tolist(), strict=True) if folded[a:e] != b.words[k - 1]]
        if not wrong:
            break
        number[wrong] = 0  # another word with the hash of one of the benchmark's
    pair = np.unique(w.text[word] * len(b.at) + some[which])
    per = b.items_from[pair % len(b.at) + 1] - b.items_from[pair % len(b.at)]
    item = b.items[np.repeat(b.items_from[pair % len(b.at)], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
    doc_item = np.unique(np.repeat(pair // len(b.at), per) * len(b.names) + item)
    none = np.zeros(0, np.int64)
    if not longest:
        return Found(hit, doc_item, none, none, none)
    occurs = np.zeros(len(b.at), bool)
    occurs[some] = True
    place = b.starts[occurs[b.window]]
    rest = b.item_at[b.item_of[place]] + np.bincount(b.item_of)[b.item_of[place]] - 1 - place  # words to the item's end
    here = _search(s.x, s.sa, b, place, rest, np.zeros(len(place), np.int64), False)
    length, first = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for near in (here - 1, here):  # the longest match is next to where the suffix would stand
        ok = np.flatnonzero((near >= 0) & (near < len(s.sa)))
        _, same = _compare(s.x, s.sa[near[ok]], b.x, place[ok], rest[ok])
        better = same > length[ok]
        length[ok[better]], first[ok[better]] = same[better], s.word[s.sa[near[ok[better]]]]
    return Found(hit, doc_item, place, length, first)


def _shards(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of SHARD_BYTES of text, about."""
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(bytes_ // SHARD_BYTES)) + 1 if len(bytes_) else []
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, int(b - a))


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Block]:
    """Blocks of BLOCK_BYTES of distinct items, about, each held by the driver for as long as it is built; a longer item is a block's part all the same."""
    items = benchmark.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / BLOCK_BYTES))
    for i in range(n):
        t = (items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)).toArrow().combine_chunks()
        if t.num_rows and (b := build(t["id"].to_pylist(), pa.concat_arrays(t["text"].chunks), window)):
            yield b


_HITS = "n_words bigint, n_hit bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>"


def _spans(w: Words, hit: np.ndarray, n_texts: int) -> tuple[np.ndarray, pa.ListArray]:
    """Words hit in each text, and runs of them, counted from its first word."""
    fresh = np.r_[True, w.text[1:] != w.text[:-1]] if len(w.text) else np.zeros(0, bool)
    no = np.arange(len(w.text)) - np.maximum.accumulate(np.where(fresh, np.arange(len(w.text)), 0)) if len(w.text) else fresh
    opens, closes = hit & (fresh | ~np.r_[False, hit[:-1]]), hit & np.r_[(fresh | ~hit)[1:], [True] * bool(len(hit))]
    spans = pa.StructArray.from_arrays([pa.array(no[opens], pa.int64()), pa.array(no[closes] + 1, pa.int64())], ["start", "stop"])
    offsets = np.searchsorted(w.text[opens], np.arange(n_texts + 1)).astype(np.int32)
    return np.bincount(w.text[hit], minlength=n_texts), pa.ListArray.from_arrays(pa.array(offsets), spans)


def _items(found: Found, b: Block, n_texts: int) -> pa.ListArray:
    lists: list[list[str]] = [[] for _ in range(n_texts)]
    for k in found.doc_item.tolist():
        lists[k // len(b.names)].append(b.names[k % len(b.names)])
    return pa.array([sorted(set(x)) for x in lists], pa.list_(pa.string()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(<id_col>, n_words, n_hit long, spans array of (start, stop), items array of string), a row for each row of docs.

    Words are runs of 0-9, a-z and all beyond ASCII, A-Z lower-cased. A window is `window` consecutive
    words of an item, or all words of a shorter one; a document's word within any occurrence of a window
    is hit. spans are the runs of hit words, counted from 0; items are the distinct ids, as sorted strings,
    of items with a window there, '' standing for a null id. Items without words say nothing. Null
    texts have no words. Rows count each, repeated ones too. An empty benchmark hits nothing.
    """
    spark, base = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def of(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _shards(batch, 1):
                    w, n, b = split_words(rows.column(1)), rows.num_rows, block.value
                    found = find(w, b, False)
                    n_hit, spans = _spans(w, found.hit, n)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.bincount(w.text, minlength=n), pa.int64()), pa.array(n_hit, pa.int64()), spans, _items(found, b, n)], names=["id", "n_words", "n_hit", "spans", "items"])

        return run

    def unhit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            empty = np.zeros(n + 1, np.int32)
            spans = pa.ListArray.from_arrays(pa.array(empty), pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(split_words(batch.column(1)).text, minlength=n), pa.int64()), pa.array(np.zeros(n), pa.int64()), spans, pa.array([[]] * n, pa.list_(pa.string()))], names=["id", "n_words", "n_hit", "spans", "items"])

    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, item_col, item_text_col)]
    schema = f"id {kind}, {_HITS}"
    if len(blocks) < 2:
        return base.mapInArrow(of(blocks[0]) if blocks else unhit, schema).withColumnRenamed("id", id_col)
    # Rows of equal id and text have the same result in every block: they meet as one, and come apart again.
    keyed = base.select(F.struct("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")).alias("id"), "text")
    schema = f"id struct<id: {kind}, digest: binary>, {_HITS}"
    parts = [keyed.mapInArrow(of(b), schema).withColumn("block", F.lit(i)) for i, b in enumerate(blocks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # collect_list sees one row a block.
    each = union.groupBy("id", "block").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("copies"))
    merged = each.groupBy("id").agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("spans", F.slice("spans", 1, 0), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= x["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(a, F.array(x))))
    merged = merged.withColumn("spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return merged.select(F.col("id.id").alias(id_col), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_hit"), "spans", "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item string, item_start, length long, <id_col>, start long): for each suffix of an item that begins with a window found anywhere, its longest verbatim match.

    item_start and start are counted in words from 0. Of matches of equal length, the smallest id (null
    last) and one of its places are given. Suffixes of equal items are told apart by item only, and rows
    of one item id and different texts by the longest match.
    """
    spark, base = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def of(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches:
                for rows in _shards(batch, 1):
                    w = split_words(rows.column(1))
                    f = find(w, b, True)
                    item = b.item_of[f.suffix]
                    first = np.searchsorted(w.text, w.text[f.word])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.names).take(pa.array(item)).cast(pa.string()), pa.array(f.suffix - b.item_at[item], pa.int64()), pa.array(f.length, pa.int64()), rows.column(0).take(pa.array(w.text[f.word])), pa.array(f.word - first, pa.int64())],
                        names=["item", "item_start", "length", "id", "start"],
                    )

        return run

    schema = f"item string, item_start bigint, length bigint, id {kind}, start bigint"
    found = [base.mapInArrow(of(spark.sparkContext.broadcast(b)), schema) for b in _blocks(benchmark, window, item_col, item_text_col)] or [spark.createDataFrame([], schema)]
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("no"), "id", "start")).alias("best")
    return union.groupBy("item", "item_start").agg(best).select("item", "item_start", (-F.col("best.l")).alias("length"), F.col("best.id").alias(id_col), F.col("best.start").alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, without those in which a window of the benchmark occurs; rules as in contamination."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, item_col, item_text_col)]
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _shards(batch, column):
                w = split_words(rows.column(column))
                hit = np.zeros(len(w.start), bool)
                for b in blocks:
                    hit |= find(w, b.value, False).hit
                yield rows.filter(pa.array(np.bincount(w.text[hit], minlength=rows.num_rows) == 0))

    return docs.mapInArrow(run, docs.schema) if blocks else docs
