"""Similarity join of shingle sets by parity sketches.

Every shingle flips one bit of a sketch.  Two sets whose sketches differ in h bits differ
in h shingles at least, so sets that may differ in D shingles agree on one of any D + 1
blocks of the sketch.  Blocks are join keys, one set of blocks for each band of sizes.

A sketch has some blocks more than that needs, so linked sets share one key more than those.
Keys have one order for all sets, the most frequent ones first, and every set leaves out as
many of its first ones: of the keys that two sets share the last one stays with both.  So
keys of passages that many sets hold vanish and no link is lost, however the order came
about.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.store import stored
from docloom.llm.words import NOT_SPACE, mixed, range_hashes, slices, split_words, window_hashes

WIDTH = 4
#: Two sets link when PART * intersection >= LEAST * union.
LEAST, PART = 85, 100
#: Bits of a block, of which only the flipped ones are looked at.  They are so many that sets
#: without a common shingle have no common key: with 256, a block of one shingle has as many
#: values, and the sets that meet in each grow with the table.
BLOCK_BITS = 1 << 32
#: Bytes of text whose sets are worked out at once; the arrays for it take fifty times as much.
SET_BYTES = 1 << 19
#: Keys that every set leaves out.
DROPPED = 3
#: The order of keys: sets that are counted about, times that make a key frequent, and keys
#: that are held as frequent at most.  Another order would cost time, but no link.
SAMPLE_SETS, FREQUENT, MOST_FREQUENT = 10_000, 4, 50_000
#: Parts into which the rows of a frequent key are dealt.
SALTS = 1024
#: Sets of a bucket whose pairs are listed; sets, and shingles of sets, of one side of a cell
#: beyond that.
FEW, CELL, CELL_SHINGLES = 4, 4000, 2_000_000
#: Bits for each set of the bitmap that tells which sets a second reading needs, and its
#: bounds: 32 MB at most.
BITS_A_SET, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


class Bands:
    """Sizes in bands, so that a set links into its own band and the next one only."""

    def __init__(self, least: int = LEAST, part: int = PART):
        self.least, self.part = least, part
        self.edges = [1]

    def upto(self, size: int) -> np.ndarray:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.part // self.least + 1)
        return np.array(self.edges)

    def difference(self, band: int) -> int:
        """Most shingles by which a set of the band and a linked one, not smaller, differ."""
        last = int(self.upto(self.edges[min(band, len(self.edges) - 1)])[band + 1]) - 1
        both = last + last * self.part // self.least
        return both * (self.part - self.least) // (self.part + self.least)

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks of a band's sketch, and how many of them two linked sets may miss by zeros.

        A block that no shingle flipped is zero, and no key.  With ``spare`` blocks more
        than D + 1 + ``DROPPED``, two linked sets agree on ``spare`` + ``DROPPED`` + 1, so on
        ``DROPPED`` + 1 that are not zero unless both have more than ``spare`` zeros; such
        sets use their zeros as keys too.
        """
        most = self.difference(band)
        if not most:
            return 0, 0
        spare, low = 0, self.edges[band]
        while True:
            n = most + 1 + DROPPED + spare
            zeros = n * math.exp(-low / n)
            if zeros + 2 * math.sqrt(zeros) <= spare or spare > most:
                return n, spare
            spare += 1


def _sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and the place of each text's first."""
    words = split_words(texts, NOT_SPACE)
    hashes = range_hashes(words.data, words.start, words.end)
    count = np.diff(words.first)
    full = window_hashes(hashes, width)
    inside = words.row[: len(full)] == words.row[width - 1 :]
    found, row = [full[inside]], [words.row[: len(full)][inside]]
    for short in range(1, width):
        rows = np.flatnonzero(count == short)
        found.append(window_hashes(hashes, short)[words.first[rows]] + np.uint64(short))
        row.append(rows)
    shingle, row = np.concatenate(found), np.concatenate(row)
    order = np.argsort(shingle)
    kind = np.uint16 if len(count) < 1 << 16 else np.int64
    order = order[np.argsort(row[order].astype(kind), kind="stable")]
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _names(shingle: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set."""
    size = np.diff(first).astype(np.uint64)
    node = mixed(_sums(mixed(shingle + np.uint64(2 * seed + 1)), first) + size)
    check = mixed(_sums(mixed(shingle ^ np.uint64(0x5851F42D4C957F2D)), first) + size)
    return node.view(np.int64), check.view(np.int64)


def sketch_words(size: int) -> int:
    """64-bit words of a set's whole sketch: a bit for each shingle at least, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, size) / 64)))


def _sketch(shingle: np.ndarray) -> np.ndarray:
    n = sketch_words(len(shingle))
    odd = np.bincount(((shingle >> np.uint64(7)) & np.uint64(64 * n - 1)).astype(np.int64), minlength=64 * n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _times(key: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often the sample had each key; 0 for those that are not frequent."""
    known, times = frequent
    if not len(known):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, times[at], 0)


def _without_first(key: np.ndarray, row: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which keys stay when each row leaves out its ``DROPPED`` most frequent ones."""
    order = np.lexsort((key, -_times(key, frequent), row))
    ordered = row[order]
    begin = np.searchsorted(ordered, ordered, side="left")
    return order[np.arange(len(order)) - begin >= DROPPED]


NO_KEYS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _keys(shingle: np.ndarray, first: np.ndarray, bands: Bands, frequent: tuple[np.ndarray, np.ndarray] = NO_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each set, and the row of each key."""
    size = np.diff(first)
    edges = bands.upto(int(size.max(initial=1)))
    own = np.searchsorted(edges, size, side="right") - 1
    keys, rows = [], []
    lowest = -(-size * bands.least // bands.part)
    below = (own > 0) & (lowest < edges[np.maximum(own, 0)])
    for band in np.unique(own[size > 0]).tolist():
        for group, chosen in ((band, own == band), (band - 1, (own == band) & below)):
            n, spare = bands.blocks(group) if group >= 0 else (0, 0)
            which = np.flatnonzero(chosen & (size > 0))
            if not n or not len(which):
                continue
            length = size[which]
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[which], length)
            h, row = shingle[at], np.repeat(which, length)
            # The upper half chooses the block, so that blocks lie in order in an ordered set.
            block = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            bit = mixed((block * np.uint64(BLOCK_BITS) + (h & np.uint64(BLOCK_BITS - 1))) * np.uint64(4099) + np.uint64(group + 1))
            new = np.ones(len(row), bool)
            new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            value = np.bitwise_xor.reduceat(bit, begin)
            place = np.uint64(group << 32) + block[begin]
            set_ = value != 0
            owner, used = row[begin][set_], block[begin][set_].astype(np.int64)
            own_keys, own_rows = [mixed(value[set_] + mixed(place[set_]))], [owner]
            zeros = n - np.bincount(owner, minlength=len(size))[which]
            for r in which[zeros > spare].tolist():
                absent = np.setdiff1d(np.arange(n), used[owner == r])
                own_keys.append(mixed(np.uint64(1) + mixed(np.uint64(group << 32) + absent.astype(np.uint64))))
                own_rows.append(np.full(len(absent), r))
            key, row = np.concatenate(own_keys).view(np.int64), np.concatenate(own_rows)
            stays = _without_first(key, row, frequent)
            keys.append(key[stays])
            rows.append(row[stays])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in slices(batch.column("text"), SET_BYTES):
            yield batch.slice(begin, end - begin)


def named_sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """id, size, the set's names (null if empty) and its whole sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices_of(batches):
            shingle, first = _sets(part.column("text"), width)
            node, check = _names(shingle, first, seed)
            size = np.diff(first)
            sketch = [_sketch(shingle[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            sketches = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32), pa.array(np.concatenate(sketch)))
            arrays = [part.column("id"), pa.array(size), pa.array(node, mask=size == 0), pa.array(check, mask=size == 0), sketches]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "size", "node", "check", "sketch"])

    return docs.mapInArrow(scan, f"id {docs.schema['id'].dataType.simpleString()}, size long, node long, check long, sketch array<long>")


def _fresh(node: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows with a set this task has not met: copies are followed no further."""
    rows = []
    for r, (name, n) in enumerate(zip(node.tolist(), size.tolist(), strict=True)):
        if n and name not in seen:
            seen.add(name)
            rows.append(r)
    return np.array(rows, np.int64)


def block_keys(docs: DataFrame, width: int, seed: int, least: int, part_: int, frequent: tuple[np.ndarray, np.ndarray] = NO_KEYS) -> DataFrame:
    """(key, node, n) for each set, once a task; n is how often the sample had a frequent key."""
    wanted = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(least, part_), set()
        for part in _slices_of(batches):
            shingle, first = _sets(part.column("text"), width)
            node = _names(shingle, first, seed)[0]
            size = np.diff(first)
            rows = _fresh(node, size, seen)
            at = np.repeat(first[rows], size[rows]) + np.arange(int(size[rows].sum())) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
            key, row = _keys(shingle[at], np.concatenate([[0], np.cumsum(size[rows])]), bands, wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[rows][row]), pa.array(_times(key, wanted.value))], ["key", "node", "n"])

    return docs.mapInArrow(scan, "key long, node long, n long")


def frequent_keys(docs: DataFrame, sets: int, width: int, seed: int, least: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent keys in order and how often they occur, from about ``SAMPLE_SETS`` different texts."""
    digest = F.xxhash64("text")
    sample = docs.filter(F.pmod(digest, F.lit(max(1, sets // SAMPLE_SETS))) == 0).groupBy(digest.alias("digest")).agg(F.first("text").alias("text"))
    counted = block_keys(sample, width, seed, least, part).groupBy("key").count().filter(F.col("count") >= FREQUENT)
    found = counted.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).toArrow().sort_by("key")
    return found.column("key").to_numpy(), found.column("count").to_numpy()


def _bitmap(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with the bit of each node set, and its size; another node's bit may be set by chance."""
    bits, n = LEAST_BITS, nodes.count()
    while bits < min(MOST_BITS, BITS_A_SET * n):
        bits *= 2
    bit = F.pmod(F.col("node"), F.lit(bits))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = nodes.groupBy((bit / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    held = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        held[batch.column("word").to_numpy()] = batch.column("mask").to_numpy()
    return held, bits


def sets_of(docs: DataFrame, nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, shingles) for the given nodes, from a second reading of the texts.

    Which sets to send on is decided in the reading task by a bitmap whose size follows
    their number up to a bound; the few others it lets through find no partner.
    """
    held, bits = _bitmap(nodes)
    wanted = docs.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bitmap = wanted.value
        for part in _slices_of(batches):
            shingle, first = _sets(part.column("text"), width)
            node = _names(shingle, first, seed)[0]
            bit = node % bits
            hit = (bitmap[bit // 64] >> (bit % 64)) & 1
            rows = _fresh(node, np.diff(first) * hit, seen)
            chosen = [shingle[first[r] : first[r + 1]].view(np.int64) for r in rows.tolist()]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *chosen])))
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), lists], ["node", "shingles"])

    found = docs.mapInArrow(scan, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def most_different(both: Column, least: int, part: int) -> Column:
    """Most shingles by which linked sets of ``both`` shingles together may differ."""
    return both - 2 * F.ceil((both * least) / (part + least))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sketches; a longer one is folded to the other's length."""

    def folded(x: Column, n: Column) -> Column:
        half = F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > n, half).otherwise(x)

    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(folded(a, n), folded(b, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def verified(pairs: DataFrame, docs: DataFrame, width: int, seed: int, least: int, part: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by the sets themselves."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = stored(sets_of(docs, nodes, width, seed), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - shared
    return met.filter(shared * part >= either * least).select("a", "b")


def similar_sets(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = WIDTH, least: int = LEAST, part: int = PART, seed: int = 0,
) -> DataFrame:
    """One row for each document: id, ``n_shingles`` and ``component_id``.

    A document's set holds its distinct shingles of ``width`` words (lower case, cut at
    white space), or its few words as one.  Sets link when ``part`` * intersection >=
    ``least`` * union; ``component_id`` is the least id reachable by links.  No link is
    lost: linked sets share a key, and every two sets that share one are compared unless
    other links have already joined them.

    Equal sets are one node from the start.  Each node is first compared with the most
    central set it shares most keys with, which joins a group of near copies by as many
    pairs as it has members; then come the pairs of a bucket that are still apart.  The
    sketches cut both down before sets are fetched.

    A document without words or text has an empty set and is its own component.  Rows
    with one id, or none, are documents of their own; a component of null ids only is
    null.  Other columns are ignored; an empty table gives no rows.
    """
    held = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = stored(named_sets(held, width, seed), "names")
    nodes = rows.filter("size > 0").groupBy("node").agg(
        F.min("check").alias("low"), F.max("check").alias("high"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
    )
    if not nodes.filter("low <> high").isEmpty():
        return similar_sets(docs, text, id_column, width, least, part, seed + 1)
    links = stored(_links(held, nodes, width, seed, least, part), "links")
    joined = rows.select("id", "size", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.filter("size > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    labelled = joined.join(lowest, "root", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return labelled.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"), component.alias("component_id"))


def near(pairs: DataFrame, nodes: DataFrame, least: int, part: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sizes and sketches allow a link."""
    for end in ("a", "b"):
        facts = nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(facts, end)
    both = F.col("size_a") + F.col("size_b")
    fits = F.least("size_a", "size_b") * part >= F.greatest("size_a", "size_b") * least
    close = hamming(F.col("sketch_a"), F.col("sketch_b")) <= most_different(both, least, part)
    return pairs.filter(fits).filter(close).select("a", "b")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows in order, cut where one of the first ``width`` columns changes."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(width)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if open_ and tuple(keys[a]) != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if open_:
        yield pa.Table.from_batches(open_)


class _Cell:
    """The sets of a cell: those of one part of a bucket (``ones``) meet those of another."""

    def __init__(self, table: pa.Table, least: int, part: int):
        side, self.node, self.root, self.size = (table.column(c).to_numpy() for c in ("side", "node", "root", "size"))
        sketch = table.column("sketch").combine_chunks()
        ends, values = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64)
        lengths = np.diff(ends)
        length = int(lengths.min())
        self.folded = np.zeros((len(lengths), length), np.uint64)
        for longer in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == longer)
            self.folded[rows] = np.bitwise_xor.reduce(values[ends[rows][:, None] + np.arange(longer)].reshape(len(rows), -1, length), axis=1)
        self.ones = np.flatnonzero(side == table.column("low")[0].as_py())
        self.others = np.flatnonzero(side == table.column("high")[0].as_py())
        self.least, self.part = least, part

    def close(self, i: int, root: np.ndarray) -> np.ndarray:
        """Others that may link with a set by size and sketch and are apart by ``root``."""
        others = self.others[root[self.others] != root[i]]
        both, less, more = self.size[others] + self.size[i], np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        others, both = (x[less * self.part >= more * self.least] for x in (others, both))
        differ = np.bitwise_count(self.folded[others] ^ self.folded[i]).sum(axis=1)
        return others[differ <= both - 2 * -(-both * self.least // (self.part + self.least))]


def _wanted_in_cell(table: pa.Table, least: int, part: int) -> np.ndarray:
    """Sets of a cell with a partner that may link."""
    cell = _Cell(table, least, part)
    wanted = np.zeros(len(cell.node), bool)
    for i in cell.ones.tolist():
        near_ones = cell.close(i, cell.root)
        wanted[near_ones] = True
        wanted[i] |= len(near_ones) > 0
    return np.unique(cell.node[wanted])


def _links_in_cell(table: pa.Table, least: int, part: int) -> list[tuple[int, int]]:
    """Links between the sets of a cell, compared whole: a forest, no link between joined ones."""
    cell = _Cell(table, least, part)
    shingles = table.column("shingles").combine_chunks()
    ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    group, found = cell.root.copy(), []
    for i in cell.ones.tolist():
        mine = values[ends[i] : ends[i + 1]]
        for j in cell.close(i, group).tolist():
            if group[i] == group[j]:
                continue
            theirs = values[ends[j] : ends[j + 1]]
            shared = len(np.intersect1d(mine, theirs, assume_unique=True))
            if shared * part >= (len(mine) + len(theirs) - shared) * least:
                group[group == group[j]] = group[i]
                found.append((int(cell.node[i]), int(cell.node[j])))
    return found


def _cells(rows: DataFrame, key: str, parts: Column, columns: list[str]) -> DataFrame:
    """Rows of groups dealt into ``parts``, of which every two meet in a cell of their own
    (key, low, high): a large group is many tasks, one of a single part is one cell."""
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    dealt = dealt.select(key, F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", *columns)
    return dealt.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def links_in_large(open_: DataFrame, nodes: DataFrame, held: DataFrame, width: int, seed: int, least: int, part: int) -> DataFrame:
    """Links (a, b) from buckets of many sets that are still apart: ``open_`` is (key, node, root, n).

    First the cells of a bucket compare sketches and name, as a group, the sets that have a
    near partner; the same group from several buckets is one.  Then the shingles of those
    sets are fetched, and cells that are smaller where sets are long compare them and send
    on a forest of links.  So what leaves a cell is never more than the sets in it.
    """
    facts = nodes.select("node", "size", "sketch")
    first = _cells(open_.join(facts, "node"), "key", F.ceil(F.col("n") / CELL), ["node", "root", "size", "sketch"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, 3):
            found = _wanted_in_cell(cell, least, part)
            name = mixed(found.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), pa.array(found)], ["group", "node"])

    near_sets = stored(first.mapInArrow(wanted, "group long, node long").distinct(), "near")
    sets = stored(sets_of(held, near_sets.select("node").distinct(), width, seed), "near-sets")
    rows = near_sets.join(open_.select("node", "root").distinct(), "node").join(facts, "node")
    volume = rows.groupBy("group").agg(F.sum("size").alias("volume"))
    met = rows.join(volume, "group").join(sets, "node")
    second = _cells(met, "group", F.ceil(F.col("volume") / CELL_SHINGLES), ["node", "root", "size", "sketch", "shingles"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, 3):
            a, b = np.array(_links_in_cell(cell, least, part), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return second.mapInArrow(linked, "a long, b long")


def _links(held: DataFrame, nodes: DataFrame, width: int, seed: int, least: int, part: int) -> DataFrame:
    frequent = frequent_keys(held, nodes.count(), width, seed, least, part)
    keys = block_keys(held, width, seed, least, part, frequent)
    # Rows of a frequent key are dealt by salts too: it is shared anyway, and about how many
    # have it is known.  Only the rest is counted in a window, which no hot key reaches.
    keys = keys.withColumn("salt", F.when(F.col("n") > 0, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0))
    bucket = Window.partitionBy("key", "salt")
    seen = keys.select("key", "salt", "node", "n", F.min("node").over(bucket).alias("low"), F.max("node").over(bucket).alias("high"), F.count(F.lit(1)).over(bucket).alias("m"))
    shared = seen.filter("n > 0 OR low <> high").select("key", "salt", "node", F.greatest("n", F.when(F.col("n") == 0, F.col("m"))).alias("n"))
    shared = stored(shared.distinct().drop("salt"), "buckets")
    # The more sets share a node's keys, the nearer it is to the middle of its group.
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("centre"))
    met = shared.select("key", "node").join(centres, "key").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    best = met.filter(F.col("node") != F.col("centre.node")).groupBy("node").agg(F.max(F.struct("times", "centre")).alias("best"))
    stars = best.select(F.col("node").alias("a"), F.col("best.centre.node").alias("b"))
    first = stored(verified(stored(near(stars, nodes, least, part), "stars"), held, width, seed, least, part), "links")
    known = components(first)
    labelled = shared.select("key", "node").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    open_ = stored(labelled.join(apart.filter("low <> high").select("key", "n"), "key"), "open")
    few = open_.filter(F.col("n") <= FEW)
    one = few.select("key", F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = one.join(two, "key").filter(F.col("root_a") < F.col("root_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = verified(stored(near(pairs, nodes, least, part), "pairs"), held, width, seed, least, part)
    large = open_.filter(F.col("n") > FEW)
    return first.union(second) if large.isEmpty() else first.union(second).union(links_in_large(large, nodes, held, width, seed, least, part))
