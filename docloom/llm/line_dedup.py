"""Line dedup by all shortest runs of lines.

At every line a chunk begins, and one ends: the shortest run of lines that reaches the
floor.  Any passage two places share that reaches it too is covered by such chunks from
its first line to its last, however long its lines are and whatever stands around it.  A
chunk that an earlier place has too is removed after its bytes have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.store import stored
from docloom.llm.words import NOT_SPACE, mixed, range_hashes, slices, split_words, string_bytes

#: A line of so many words is a passage, and a chunk, of its own; other chunks have two
#: lines and so many words at least.
LONG_WORDS, LEAST_WORDS = 20, 10
#: Words at least of a chunk of two lines or more, and of a chunk of one line.
CUTS = (LEAST_WORDS, LONG_WORDS)
#: An odd number: the base of the hashes of runs of lines.
BASE = 0x9E3779B97F4A7C15
BITMAP_BITS = 1 << 26


def line_ranges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begin and end of every line, and each text's first line.  An empty text has none."""
    data, offsets = string_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    filled = np.diff(offsets) > 0
    begin = np.sort(np.concatenate([offsets[:-1][filled], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:][filled], breaks]), kind="stable")
    count = np.diff(np.searchsorted(breaks, offsets)) + filled
    return data, begin, end, np.concatenate([[0], np.cumsum(count)])


def _shortest(sums: np.ndarray, top: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the shortest runs of two lines and ``least`` words, from
    each line on and up to each line, inside the line's text; ``sums`` are those of words."""
    n = len(top)
    worded = np.diff(sums) > 0
    # A run of blank lines gives its last one as a begin and its first one as an end.
    begin = np.flatnonzero(worded | np.append(worded[1:], False))
    end = np.maximum(np.searchsorted(sums, sums[begin] + least), begin + 2)
    inside = end <= stop[begin]
    last = np.flatnonzero(worded | np.append(False, worded[:-1]))
    first = np.minimum(np.searchsorted(sums, sums[last + 1] - least, side="right") - 1, last - 1)
    within = first >= top[last]
    both = np.unique(np.concatenate([begin[inside] * (n + 1) + end[inside], first[within] * (n + 1) + last[within] + 1]))
    return both // (n + 1), both % (n + 1)


def chunks(texts: pa.Array, cuts: tuple[int, int] = CUTS) -> tuple[np.ndarray, ...]:
    """Chunks worth comparing: hash, row, first line in the row, number of lines, and the
    blank lines beside it in the row, before a blank first and after a blank last line."""
    least, long_ = cuts
    data, begin, end, first = line_ranges(texts)
    n = len(begin)
    words = split_words(texts, NOT_SPACE).start
    n_words = np.searchsorted(words, end) - np.searchsorted(words, begin)
    sums = np.concatenate([[0], np.cumsum(n_words)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top, stop = first[row], first[row + 1]
    head, tail = _shortest(sums, top, stop, least)
    # A run of lines that are all chunks of their own finds nothing more.
    longs = np.concatenate([[0], np.cumsum(n_words >= long_)])
    more = longs[tail] - longs[head] < tail - head
    head, tail = head[more], tail[more]
    alone = np.flatnonzero(n_words >= long_)
    head, tail = np.concatenate([head, alone]), np.concatenate([tail, alone + 1])
    # Order counts: a run's hash is a polynomial in BASE, from sums over all lines.
    power, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, BASE, np.uint64), out=power[1:])
    np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64), out=back[1:])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(range_hashes(data, begin, end)) * power[:-1], out=total[1:])
    size = tail - head
    value = mixed((total[tail] - total[head]) * back[head] + size.astype(np.uint64))
    at, blank = np.arange(n), n_words == 0
    previous = np.maximum(np.maximum.accumulate(np.where(blank, -1, at)), top - 1)
    following = np.minimum(np.minimum.accumulate(np.where(blank, n, at)[::-1])[::-1], stop)
    before = np.where(blank[head], head - 1 - previous[head], 0)
    after = np.where(blank[tail - 1], following[tail - 1] - tail, 0)
    return value, row[head], head - top[head], size, before, after


_KEY = [T.StructField("key", T.LongType()), T.StructField("twin", T.LongType())]


def _keyed(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """The documents as ``doc``, ``id``, ``text`` and a key of two hashes; equal rows share it."""
    rest = [c for c in docs.columns if c != text]
    parts = [F.col(id_column).cast("string"), F.col(text), F.col(id_column).isNull(), F.col(text).isNull()]
    return docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("doc"),
        F.col(id_column).alias("id"), F.col(text).alias("text"),
        F.xxhash64(F.lit(1), *parts).alias("key"), F.xxhash64(F.lit(2), *parts).alias("twin"),
    )


def _place_hash(chunk: np.ndarray, key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return mixed(chunk.view(np.uint64) + mixed(key.view(np.uint64) + begin.astype(np.uint64)))


def _chunk_rows(keyed: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                value, row, begin, size, _, _ = chunks(part.column("text"), cuts)
                ids, key, twin = (part.column(c).take(pa.array(row)) for c in ("id", "key", "twin"))
                place = _place_hash(value, key.to_numpy(), begin)
                arrays = [pa.array(value.view(np.int64)), ids, key, twin, pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(place.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "id", "key", "twin", "begin", "size", "place"])

    columns = [("chunk", T.LongType()), ("id", keyed.schema["id"].dataType), ("key", T.LongType()), ("twin", T.LongType()), ("begin", T.IntegerType()), ("size", T.IntegerType()), ("place", T.LongType())]
    return keyed.select("id", "text", "key", "twin").mapInArrow(scan, T.StructType([T.StructField(n, k) for n, k in columns]))


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with the bit of each value set."""
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = values.groupBy((bit / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    held = np.zeros(BITMAP_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():
        held[batch.column("word").to_numpy()] = batch.column("mask").to_numpy()
    return held


def _first_texts(keyed: DataFrame, firsts: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    """(place, before, lines, after) of the first places, from a second reading.

    A bitmap of fixed size tells the reading task which chunks to send on; the few others
    it lets through are joined by nothing.
    """
    wanted = keyed.sparkSession.sparkContext.broadcast(_bitmap(firsts, "place"))
    lines = pa.list_(pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                value, row, begin, size, before, after = chunks(part.column("text"), cuts)
                place = _place_hash(value, part.column("key").to_numpy()[row], begin).view(np.int64)
                bit = place % BITMAP_BITS
                hit = np.flatnonzero((bitmap[bit // 64] >> (bit % 64)) & 1)
                own: dict[int, list[str]] = {}
                held = []
                for k in hit.tolist():
                    r, at, n = int(row[k]), int(begin[k]), int(size[k])
                    if r not in own:
                        own[r] = part.column("text")[r].as_py().split("\n")
                    held.append((place[k], own[r][at - before[k] : at], own[r][at : at + n], own[r][at + n : at + n + after[k]]))
                columns = list(zip(*held, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, lines) for c in columns[1:]]], ["place", "before", "lines", "after"])

    found = keyed.select("text", "key").mapInArrow(scan, "place long, before array<string>, lines array<string>, after array<string>")
    return found.dropDuplicates(["place"])


def _drop(lines: list[str], removals: list[dict]) -> list[bool]:
    """Which lines go: those of a removal that is equal byte for byte, and equal blank neighbours."""
    gone = [False] * len(lines)
    for r in removals:
        at, own = r["begin"], r["lines"]
        stop = at + len(own)
        if lines[at:stop] != own:
            continue
        low, high = at, stop
        while low > 0 and at - low < len(r["before"]) and lines[low - 1] == r["before"][low - at - 1]:
            low -= 1
        while high < len(lines) and high - stop < len(r["after"]) and lines[high] == r["after"][high - stop]:
            high += 1
        gone[low:high] = [True] * (high - low)
    return gone


def drop_repeated_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", cuts: tuple[int, int] = CUTS) -> DataFrame:
    """The documents, all columns kept, without repeated passages, and ``n_lines``, ``n_removed``.

    Places are ordered by id (nulls last), hash of the row and line; the first place of a
    chunk keeps it, all later ones lose it, in the same document too.  A line goes only
    if an earlier place has an equal one, so some place keeps every line.  A chunk has
    two lines or more and ``LEAST_WORDS`` words, or is one line of ``LONG_WORDS`` words;
    every passage of that size that an earlier place has too goes whole, but for blank
    lines at its ends.

    Rows equal in id and text are one document and lose the same lines.  Null and empty
    texts have no lines and stay as they are.  A text all of whose lines go becomes
    empty.  Columns of the result's names are replaced; an empty table gives no rows.
    """
    keyed = _keyed(docs, text, id_column)
    rows = stored(_chunk_rows(keyed, cuts), "chunks")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "twin", "begin", "place")
    # Partial minima meet before the shuffle, however often a chunk occurs.
    least = rows.groupBy("chunk").agg(F.min(order).alias("first"), F.max(F.struct("key", "begin")).alias("high"), F.min(F.struct("key", "begin")).alias("low"))
    firsts = least.filter("low <> high").select("chunk", F.col("first.key").alias("first_key"), F.col("first.twin").alias("first_twin"), F.col("first.begin").alias("first_begin"), F.col("first.place").alias("place"))
    firsts = stored(firsts, "firsts")
    texts = _first_texts(keyed, firsts, cuts)
    origin = firsts.join(texts, "place")
    same = (F.col("key") == F.col("first_key")) & (F.col("twin") == F.col("first_twin")) & (F.col("begin") == F.col("first_begin"))
    later = rows.select("chunk", "key", "twin", "begin").distinct().join(origin, "chunk").filter(~same)
    removals = later.groupBy("key", "twin").agg(F.collect_list(F.struct("begin", "before", "lines", "after")).alias("removals"))
    joined = keyed.join(removals, ["key", "twin"], "left").select("doc", "text", "removals")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, gone_counts = [], [], []
            for t, removals in zip(batch.column("text"), batch.column("removals"), strict=True):
                whole = t.as_py()
                lines = whole.split("\n") if whole else []
                gone = _drop(lines, removals.as_py()) if removals.is_valid else []
                out.append("\n".join(line for line, g in zip(lines, gone, strict=True) if not g) if any(gone) else whole)
                counts.append(len(lines))
                gone_counts.append(sum(gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64())], ["doc", "text", "n_lines", "n_removed"])

    schema = T.StructType([joined.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = joined.mapInArrow(cut, schema)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*[(F.col("text") if c == text else F.col(f"doc.`{c}`")).alias(c) for c in kept], "n_lines", "n_removed")
