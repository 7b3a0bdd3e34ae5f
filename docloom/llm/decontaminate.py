"""Benchmark decontamination: phrases of test items are searched in indexes of the training texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.fm_index import FMIndex
from docloom.llm.store import stored
from docloom.llm.words import LETTER_DIGIT, SLICE_BYTES, Words, range_hashes, slices, split_words, string_bytes

WINDOW = 10
#: Words of test items in a block: the unit that a task holds at least.
BLOCK_WORDS = 200_000
#: Bytes of blocks that a task keeps from slice to slice, and of texts in a slice at most
#: (a longer text is a slice of its own).
KEPT_BYTES = 64 << 20
MOST_SLICE_BYTES = 16 << 20


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in an ordered array, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


@dataclass
class Phrases:
    """The distinct windows of a block of items.

    A word's symbol is its place in the ordered hashes.  ``by_length`` maps a window's
    length to its symbols, one window a row, and the items that hold it.
    """

    hashes: np.ndarray
    words: list[bytes]
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]


def phrases_of(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    """Windows of ``(item, text)``; an item without an id is searched but not named."""
    words = split_words(pa.array([t for _, t in items], pa.string()), LETTER_DIGIT)
    hashes = range_hashes(words.data, words.start, words.end)
    distinct, first, symbol = np.unique(hashes, return_index=True, return_inverse=True)
    found: dict[int, dict[tuple, set]] = {}
    for row, (item, _) in enumerate(items):
        own = symbol[words.first[row] : words.first[row + 1]]
        width = min(window, len(own))
        for at in range(len(own) - width + 1 if width else 0):
            found.setdefault(width, {}).setdefault(tuple(own[at : at + width].tolist()), set()).add(item)
    by_length = {
        width: (np.array(list(windows), np.int32), [sorted(i for i in named if i is not None) for named in windows.values()])
        for width, windows in found.items()
    }
    return Phrases(distinct, [words.text(i) for i in first.tolist()], by_length)


class TextIndex:
    """An FM-index of the words of some texts, symbol 1 behind each text.

    A word's symbol is the place of its hash among those of the texts, plus 2.
    """

    def __init__(self, words: Words):
        self.words, self.row = words, words.row
        hashes = range_hashes(words.data, words.start, words.end)
        self.hashes, symbol = np.unique(hashes, return_inverse=True)
        symbols = np.ones(len(hashes) + len(words.first) - 1, np.int64)
        symbols[np.arange(len(hashes)) + self.row] = symbol + 2
        # The word at each place; a place behind a text is never located.
        self.word = np.cumsum(symbols != 1) - 1
        self.index = FMIndex(symbols, len(self.hashes) + 2) if len(hashes) else None

    def find(self, phrases: Phrases, hit: np.ndarray, items: list[set[str]]) -> None:
        """Marks the words that lie in an occurrence of a phrase, and names each row's items.

        An occurrence counts only if its bytes are the phrase's.
        """
        if self.index is None:
            return
        at, known = _member(phrases.hashes, self.hashes)
        symbols = np.where(known, at + 2, 0)
        same: dict[int, bool] = {}
        for width, (windows, named) in phrases.by_length.items():
            own = symbols[windows]
            chosen = np.flatnonzero((own > 0).all(axis=1))
            which, low, high = self.index.search(own[chosen])
            owner, start = self.index.locate(low, high)
            for phrase, first in zip(chosen[which[owner]].tolist(), self.word[start].tolist(), strict=True):
                for k in range(width):
                    if first + k not in same:
                        same[first + k] = self.words.text(first + k) == phrases.words[windows[phrase, k]]
                if all(same[first + k] for k in range(width)):
                    hit[first : first + width] = True
                    items[self.row[first]].update(named[phrase])


class Blocks:
    """Blocks of phrases in the shared folder; a task keeps some and reads the others again."""

    def __init__(self, files: list[str]):
        self.files = files
        self.kept: list[Phrases] | None = None

    def __iter__(self) -> Iterator[Phrases]:
        if self.kept is not None:
            yield from self.kept
            return
        kept, size = [], 0
        for file in self.files:
            # Hadoop's name of the S3 client is no scheme elsewhere.
            fs, path = pafs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
            with fs.open_input_file(path) as held:
                for batch in pq.ParquetFile(held).iter_batches(batch_size=1, columns=["phrases"]):
                    for stored_block in batch.column(0).to_pylist():
                        block = pickle.loads(stored_block)
                        size += len(stored_block)
                        if size <= KEPT_BYTES:
                            kept.append(block)
                        yield block
        if size <= KEPT_BYTES:
            self.kept = kept


_RANGES_TYPE = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", _RANGES_TYPE), T.StructField("spans", _RANGES_TYPE),
]
_RANGE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _ranges(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words inside a row: row, first and last word."""
    at = np.flatnonzero(hit)
    row = words.row[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    last = np.ones(len(at), bool)
    last[:-1] = new[1:]
    return row[new], at[new], at[last]


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    cuts = [0, *[p for s in spans for p in (s["begin"], s["end"])], len(text)]
    return "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _search_slice(texts: pa.Array, blocks: Blocks) -> dict[str, list]:
    """One index of a slice of texts, through which all blocks of phrases pass."""
    words = split_words(texts, LETTER_DIGIT)
    index = TextIndex(words)
    n = len(texts)
    hit = np.zeros(len(words.start), bool)
    items: list[set[str]] = [set() for _ in range(n)]
    for phrases in blocks:
        index.find(phrases, hit, items)
    row, first, last = _ranges(words, hit)
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    base = words.first[row]
    offset = points[string_bytes(texts)[1][row]]
    found = {"n_words": np.diff(words.first).tolist(), "n_hit": np.bincount(index.row[hit], minlength=n).tolist()}
    found["items"] = [sorted(named) for named in items]
    found["words"], found["spans"] = [[] for _ in range(n)], [[] for _ in range(n)]
    places = zip(row.tolist(), (first - base).tolist(), (last - base + 1).tolist(), (points[words.start[first]] - offset).tolist(), (points[words.end[last]] - offset).tolist(), strict=True)
    for r, a, b, begin, end in places:
        found["words"][r].append({"begin": a, "end": b})
        found["spans"][r].append({"begin": begin, "end": end})
    return found


def phrase_blocks(items: DataFrame, text: str, item_id: str, window: int, block_words: int) -> list[str]:
    """The items in blocks of about ``block_words`` words, as files in the shared folder: their names.

    An item goes to a block by hash; each block is made in a task of its own.
    """
    chosen = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # A word and what parts it from the next take two bytes at least.
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * block_words)))
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))

    def build(block: pa.Table) -> pa.Table:
        held = phrases_of(list(zip(block.column("item").to_pylist(), block.column("text").to_pylist(), strict=True)), window)
        return pa.table({"phrases": pa.array([pickle.dumps(held)], pa.binary())})

    return sorted(stored(dealt.groupBy("block").applyInArrow(build, "phrases binary"), "phrases").inputFiles())


def _search(docs: DataFrame, keep: list[str], items: DataFrame, text: str, item_text: str, item_id: str, window: int, block_words: int, cleaned: bool) -> DataFrame:
    """One pass over the texts, however many blocks there are; ``cleaned``: texts come back without the spans."""
    frame = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(text).alias("text"))
    blocks = Blocks(phrase_blocks(items, item_text, item_id, window, block_words))
    # The more blocks are read again for each slice, the larger the slices.
    limit = min(MOST_SLICE_BYTES, SLICE_BYTES * max(1, len(blocks.files)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text"), limit):
                part = batch.slice(begin, end - begin)
                text = part.column("text")
                found = _search_slice(text, blocks)
                if cleaned:
                    text = pa.array([_without(t.as_py(), s) if s else t.as_py() for t, s in zip(text, found["spans"], strict=True)], pa.string())
                else:
                    text = pa.nulls(len(text), pa.string())
                arrays = [
                    part.column("doc"), text, pa.array(found["n_words"], pa.int64()), pa.array(found["n_hit"], pa.int64()),
                    pa.array(found["items"], pa.list_(pa.string())), pa.array(found["words"], _RANGE), pa.array(found["spans"], _RANGE),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "text", "n_words", "n_hit", "items", "words", "spans"])

    return frame.mapInArrow(scan, T.StructType([frame.schema["doc"], frame.schema["text"], *FOUND]))


def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each document: id, ``n_words``, ``n_hit``, ``items``, ``words`` and ``spans``.

    A phrase is ``window`` consecutive words of an item, or the whole of a shorter item.
    ``items`` are the ids, as sorted strings, of items with a phrase in the text;
    ``words`` and ``spans`` the merged runs of hit words, in words and in code points.

    Texts never move: each slice of a partition gets one index of its whole texts, in
    which all blocks of items are searched in turn.  Items are dealt to blocks and written
    to the shared folder by tasks; the driver sees the names of the files.  Null and empty
    texts have no words, null and empty items no phrases; an item without an id hits but
    is not named; rows with one item id count as one item.  Repeated documents and null
    ids stay as they are, other columns are ignored, and an empty table of documents
    gives no rows, one of items no hits.
    """
    found = _search(docs, [id_column], items, text, item_text, item_id, window, block_words, False)
    return found.select(F.col(f"doc.`{id_column}`").alias(id_column), "n_words", "n_hit", "items", "words", "spans")


def remove_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, all columns kept, without the spans ``find_contamination`` reports."""
    rest = [c for c in docs.columns if c != text]
    found = _search(docs, rest, items, text, item_text, item_id, window, block_words, True)
    return found.select(*[(F.col("text") if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
