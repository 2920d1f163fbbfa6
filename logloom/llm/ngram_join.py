"""Jaccard self-join of documents on word n-grams, exact, returning groups of linked documents.

1. Every text becomes a sorted set of 64-bit n-gram hashes; equal sets meet in one class, so
   exact copies cost one row.
2. Sets are dealt into tiles by size band. Two sets that link differ in at most H n-grams, H
   following from the band's sizes. The n-grams of a set fall into k = H + 1 + slack parts by
   hash; at least 1 + slack parts are then equal in both. A tile is (band, part, content of the
   part); sets that meet in no tile cannot link. A set whose empty parts are within the slack
   leaves them out: a non-empty equal part remains; others are dealt again by another hash.
3. Tiles only chain their members into candidate groups (one edge a member, first inside map
   tasks, so that no tile gathers more rows than there are map batches).
4. Within a candidate group, sets carry hashed bitmap signatures, as wide as their size asks for.
   Bit counts bound the overlap of two sets from above; pairs that pass get an exact sorted-array
   intersection, unless links found already put them together. Large groups are cut into blocks:
   first every block with the group's smallest set, then only blocks of what that left over
   against all blocks. Before that, large groups are taken apart by their rarest n-grams.

Only texts of candidate sets move, one a set; their n-grams are made again where they meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, forget, written
from .components import connected_components

#: Sets in a block of a candidate group, and n-grams in it, about.
BLOCK, BLOCK_GRAMS = 3000, 4_000_000
#: Bits of the narrowest signature; a signature has twice the bits that its set has n-grams, or more.
SIGNATURE = 1024
#: Keys gathered before a map task chains them.
FLUSH = 2_000_000
#: Hashes that deal out sets with many empty parts.
LEVELS = 6

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased; shorter texts are one shingle."""
    words = (text or b"").lower().split()  # of bytes: A-Z; splits at blank and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = _mix(out + _M) ^ h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def set_id(s: np.ndarray) -> int:
    """63 bits that name a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


class Bands:
    """Size bands for links at 100 * intersection >= percent * union."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] <= largest:
            self.lows.append(self.lows[-1] * 100 // percent + 1)
        self.lows.append(self.lows[-1] * 100 // percent + 1)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts for pairs whose larger set is in the band, and the slack within it."""
        most = 2 * (self.lows[band + 1] - 1)
        differ = (100 - self.percent) * most // (100 + self.percent)
        each = self.lows[max(band - 1, 0)] / (differ + 1)
        slack = 0 if differ < 8 else 2 + math.ceil(1.5 * (differ + 1) * math.exp(-each))
        return differ + 1 + slack, slack


def tile_keys(s: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """Keys of the tiles that a set belongs to: those of its own band and of the next.

    A set with more empty parts than the slack is dealt again by another hash, and on the last
    level keeps its empty parts. Both sets of a pair that shares no tile on a level go on to the
    next, so no pair is lost, and tiles of empty parts stay rare.
    """
    out, own = [], bands.of(len(s))
    mixed = _mix(s + _M)
    for band in (own, own + 1):
        k, slack = bands.parts(band)
        for level in range(LEVELS):
            part = (_mix(s + np.uint64(level)) % np.uint64(k)).astype(np.int64)
            content = np.zeros(k, np.uint64)
            np.add.at(content, part, mixed)
            empty = np.bincount(part, minlength=k) == 0
            last = empty.sum() <= slack or level == LEVELS - 1
            at = np.arange(k) if level == LEVELS - 1 else np.flatnonzero(~empty)
            out.append(_mix(content[at] ^ _mix(np.uint64((level << 48) + (band << 32)) + at.astype(np.uint64) + _M)))
            if last:
                break
    return out


def chain(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key's smallest id; and distinct edges from each other id of a key to that one."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    start = np.r_[True, keys[1:] != keys[:-1]]
    low = ids[np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))]
    other = low != ids
    edges = np.unique(np.stack([ids[other], low[other]], 1), axis=0)
    return keys[start], ids[start], edges[:, 0], edges[:, 1]


def width(size: int) -> int:
    """Bits of the signature of a set of this size: a power of two."""
    return max(SIGNATURE, 1 << (2 * size - 1).bit_length())


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """One bit is set for each n-gram."""
    on = np.zeros(bits, np.uint8)
    on[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_tile(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a tile as all their links do.

    Sets come in ascending size; each meets those before it whose size is near enough. A common
    n-gram is a common bit, and the bits that only one set has are n-grams that only it has, so
    |a| - popcount(a & ~b) bounds the overlap from above.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    bits = np.array([width(x) for x in size.tolist()])
    group, out, first, end, sigs = np.arange(n), [], 0, 0, np.empty((0, 0), np.uint64)
    for i in range(1, n):
        low = int(np.searchsorted(size[:i], -(-percent * int(size[i]) // 100)))
        if low >= i:
            continue
        if i >= end:  # signatures of one width, and those smaller sets that meet these, at the same width
            first, end = low, int(np.searchsorted(bits, bits[i], "right"))
            sigs = np.stack([signature(s, int(bits[i])) for s in sets[first:end]])
        w, v = slice(low, i), slice(low - first, i - first)
        mine = sigs[i - first]
        need = -(-percent * (size[w] + size[i]) // (100 + percent))  # least overlap that links
        only_a = np.bitwise_count(sigs[v] & ~mine).sum(1, dtype=np.int64)
        only_b = np.bitwise_count(~sigs[v] & mine).sum(1, dtype=np.int64)
        bound = np.minimum(size[w] - only_a, size[i] - only_b)
        todo = np.flatnonzero(bound >= need) + low
        todo = todo[np.argsort(need[todo - low] - bound[todo - low], kind="stable")]
        while len(todo):
            j = int(todo[0])
            if linked(sets[j], sets[i], percent):
                out.append((ids[i], ids[j]))
                group[group == group[i]] = group[j]
            todo = todo[1:]
            todo = todo[group[todo] != group[i]]
    return out


def _batches(spark_batches: Iterator[pa.RecordBatch], n: int):
    """(columns, sets) of a few hundred rows at a time; the text is the last column, binary."""
    for batch in spark_batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, [shingle_set(t, n) for t in part.column(part.num_columns - 1).to_pylist()]


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups of documents whose n-word shingle sets link at 100 * intersection >= percent * union.

    Returns for each row of docs <id_col>, n_shingles long, component_id (the smallest id reachable
    by links, itself included). Words are maximal runs of characters other than blank and
    \\x09-\\x0D, A-Z lower-cased; texts of fewer than n words are one shingle; texts without words,
    null ones too, have an empty set and link with nothing. Rows that repeat an id are rows of
    their own, linked as their texts are. A null id is smaller than none: its component is the
    smallest non-null id of the group, or null. Other columns are ignored.
    """
    members, of_set = _labelled(docs, n, percent, id_col, text_col, block)
    size, name = F.col("n").alias("n_shingles"), F.col("id").alias(id_col)
    alone = members.where("set IS NULL").select(name, size, F.col("id").alias("component_id"))
    return members.where("set IS NOT NULL").join(of_set, "set").select(name, size, "component_id").unionByName(alone)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group: that of the smallest id, nulls last, then of the smallest hash of its text.

    Of rows that repeat both id and text one stays. Texts without words, equal to nothing, all stay.
    """
    members, of_set = _labelled(docs, n, percent, id_col, text_col, BLOCK)
    low = members.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "fp")).alias("low"))
    stays = written(low.join(of_set, "set").groupBy("label").agg(F.min("low").alias("low")).select(F.col("low.id").alias("id"), F.col("low.fp").alias("fp")), "stays", (members, of_set))
    # Keys without nulls, so that the join and the choice of one row are dealt out alike.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).isNull().alias("no"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)).alias("worded"))
    stays = stays.select(F.col("id").isNull().alias("no"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "fp")
    one = keyed.where("worded").join(stays, ["no", "id", "fp"], "left_semi").dropDuplicates(["no", "id", "fp"])
    return one.select("row.*").unionByName(keyed.where("NOT worded").select("row.*"))


def _labelled(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (id, fp, set, n) of each row, fp its text's hash; and (set, label, component_id), label equal within a group."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), F.col(text_col).cast("binary").alias("t"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, n):
            names = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names, pa.array([len(s) for s in sets], pa.int64())], names=["id", "fp", "set", "n"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, set) of the tiles; sets that a task's own tiles chain come as tiles of two."""
        bands, seen, keys, ids, held = Bands(percent, 1 << 40), set(), [], [], 0

        for _, sets in _batches(batches, n):
            for s in sets:
                if len(s) and (x := set_id(s)) not in seen:
                    seen.add(x)
                    for k in tile_keys(s, bands):
                        keys.append(k)
                        ids.append(np.full(len(k), x, np.int64))
                        held += len(k)
            if held > FLUSH:
                yield _flushed(keys, ids)
                keys, ids, held, seen = [], [], 0, set()
        if held:
            yield _flushed(keys, ids)

    members = written(base.mapInArrow(sizes, f"id {kind}, fp bigint, set bigint, n bigint"), "sets")
    # Of each set its smallest row, nulls last.
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "fp"))
    classes = members.where("set IS NOT NULL").groupBy("set").agg(least.alias("x")).select("set", "x.id", "x.fp")
    tiles = base.select("t").mapInArrow(keyed, "key bigint, set bigint")
    grouped = connected_components(_edges(tiles), "set", "other", "set", "group")
    sets = _regrouped(_candidates(base, grouped, classes, n), n, percent, block)
    labels = _joined(sets, n, percent, block)
    forget(sets)
    named = classes.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    return members, written(named.select("set", "label").join(lowest, "label"), "labels", (labels,))


def _edges(tiles: DataFrame) -> DataFrame:
    """(set, other): edges from the sets of each tile (key, set) to its smallest; a tile's rows stream, whatever their number."""
    return tiles.repartition("key").sortWithinPartitions("key", "set").mapInArrow(_chained, "set bigint, other bigint")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the sets of a tile to its smallest; rows come sorted by key and set."""
    key = low = None
    for batch in batches:
        k, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.r_[k[0] != key if key is not None else True, k[1:] != k[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
        first = np.where(at >= 0, s[np.maximum(at, 0)], low if low is not None else 0)
        key, low = k[-1], first[-1]
        other = first != s
        e = np.unique(np.stack([s[other], first[other]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0], pa.int64()), pa.array(e[:, 1], pa.int64())], names=["set", "other"])


def _flushed(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (key, set) of tiles, once a key; sets that these tiles chain come as tiles of two."""
    k, low, a, b = chain(np.concatenate(keys), np.concatenate(ids))
    pairs = _mix(a.view(np.uint64) ^ _mix(b.view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(np.r_[k, pairs, pairs].view(np.int64)), pa.array(np.r_[low, a, b])], names=["key", "set"])


def _candidates(base: DataFrame, grouped: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(set, group, n, t), written: one text for each set of a candidate group, or a few equal ones where a row is repeated."""
    chosen = written(grouped.join(classes, "set").select(F.col("id").alias("of"), F.col("fp").alias("of_fp"), "set", "group"), "chosen", (grouped,))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # within a task; sets are met a few times at most, by tasks that hold the same row
        for part, sets in _batches(batches, n):
            keep = []
            for i, (x, s) in enumerate(zip(part.column(0).to_pylist(), sets, strict=True)):
                if x not in seen and set_id(s) == x:
                    seen.add(x)
                    keep.append(i)
            rows = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(sets[i]) for i in keep], pa.int64()), rows.column(2)], names=["set", "group", "n", "t"])

    found = base.join(broadcast_if_small(chosen), F.col("id").eqNullSafe(F.col("of")) & (F.col("fp") == F.col("of_fp"))).select("set", "group", "t")
    return written(found.mapInArrow(texts, "set bigint, group bigint, n bigint, t binary"), "texts", (chosen,))


def _regrouped(sets: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """sets, a written table, with its large groups taken apart; sets that turn out to link with nothing go.

    Passages that documents share chain their tiles into groups that grow faster than the corpus.
    Of such groups' sets, rarest n-grams first, linked sets have one of their first size -
    least overlap + 1 in common: those n-grams are new tiles. A set with that many n-grams of its
    own links with nothing.
    """
    big = written(_large_groups(sets, block), "big")
    if big.isEmpty():
        forget(big)
        return sets

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, n):
            names = np.repeat(part.column(0).to_numpy(), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["set", "gram"])

    def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            ids.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > FLUSH:
                yield _flushed(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield _flushed(keys, ids)

    large = sets.join(broadcast_if_small(big), "group", "left_semi")
    rows = large.select("set", "t").mapInArrow(grams, "set bigint, gram bigint")
    shared = rows.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    of_set = rows.join(shared, "gram").groupBy("set").agg(F.array_sort(F.collect_set(F.struct("often", "gram"))).alias("shared"))
    sizes = large.groupBy("set").agg(F.max("n").alias("n"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    take = (first - (F.col("n") - F.size("shared"))).cast("int")
    prefix = of_set.join(sizes, "set").withColumn("take", take).where("take > 0").select(F.explode(F.transform(F.slice("shared", 1, F.col("take")), lambda x: x["gram"])).alias("key"), "set")
    again = connected_components(_edges(prefix.mapInArrow(flushed, "key bigint, set bigint")), "set", "other", "set", "group")
    small = sets.join(broadcast_if_small(big), "group", "left_anti")
    return written(small.select("set", "group", "n", "t").unionByName(large.drop("group").join(again, "set").select("set", "group", "n", "t")), "texts", (sets, big, again))


def _large_groups(sets: DataFrame, block: int) -> DataFrame:
    """(group, blocks) of groups that fill more than one block."""
    return sets.groupBy("group").agg(_blocks(block).alias("blocks")).where("blocks > 1")


def _blocks(block: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_GRAMS)).cast("int")


def _joined(sets: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(set, label), written: the sets that have links, label equal for those that links connect."""
    big = written(_large_groups(sets, block), "big")
    sets = sets.join(broadcast_if_small(big), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    # The set that names a large group goes to all its blocks.
    everywhere = F.when(F.col("set") == F.col("group"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
    links = written(_link(sets.withColumn("tile", F.explode(everywhere)), ["group", "tile"], n, percent), "links")
    done = [big]
    if not big.isEmpty():
        # Of large groups: what is not linked with the naming set yet, against everything, in blocks.
        large = sets.where("blocks > 1")
        labels = connected_components(links.join(large.select("set"), "set", "left_semi"), "set", "other", "set", "label")
        labelled = written(large.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), "large", (labels,))
        core = written(labelled.where(F.col("set") == F.col("group")).select("group", F.col("label").alias("core_label")).distinct(), "core")
        placed = labelled.join(broadcast_if_small(core), "group").withColumn("rest", F.col("label") != F.col("core_label"))
        left = written(placed.where("rest").groupBy("group").agg(_blocks(block).alias("rests")), "left")
        placed = placed.join(broadcast_if_small(left), "group").withColumn("mine", mine).withColumn("rest_block", F.pmod(F.xxhash64("set", F.lit(1)), F.col("rests")).cast("int"))
        pair = lambda r, b: F.struct(r.alias("r"), b.alias("b"))
        with_core: Column = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: pair(F.col("rest_block"), b))
        with_rest: Column = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: pair(F.least(r, F.col("rest_block")), -1 - F.greatest(r, F.col("rest_block"))))
        as_core: Column = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: pair(r, F.col("mine")))
        second = placed.withColumn("tile", F.explode(F.when(F.col("rest"), F.concat(with_core, with_rest)).otherwise(as_core)))
        links = written(links.unionByName(_link(second, ["group", "tile"], n, percent)), "links", (links,))
        done += [labelled, core, left]
    labels = connected_components(links, "set", "other", "set", "label")
    forget(links, *done)
    return labels


def _link(rows: DataFrame, by: list[str], n: int, percent: int) -> DataFrame:
    """Links (set, other) of each tile; a tile's rows stream in ascending size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets = None, [], []

        def out():
            found = link_tile(ids, sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["set", "other"])

        for part, grams in _batches(batches, n):
            for t, s, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), grams, strict=True):
                if t != tile:
                    if len(ids) > 1:
                        yield out()
                    tile, ids, sets = t, [], []
                if not ids or ids[-1] != s:
                    ids.append(s)
                    sets.append(g)
        if len(ids) > 1:
            yield out()

    key = F.struct(*by)
    return rows.repartition(*by).sortWithinPartitions(*by, "n", "set").select(key.alias("tile"), "set", "t").mapInArrow(run, "set bigint, other bigint")
