"""Language identification by prediction by partial matching.

For each language the bytes that followed every context of up to three bytes are counted
once; then the statistics are frozen.  A text's code length under a language is the exact
sum over its bytes: an escape from each context that has not seen the byte, with the
bytes seen there excluded further down.  The shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.words import slices, string_bytes

ORDER = 3
#: The bound of the training sample: bytes of a language, and of all together.
LANGUAGE_BYTES = 2_000_000
SAMPLE_BYTES = 16_000_000
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
_SLOTS = 1 << 20
_SPREAD = np.uint32(2654435761)

#: ASCII letters in lower case, other bytes of ASCII as white space, the rest as it is.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[128:] = np.arange(128, 256)
for _letter in range(97, 123):
    _CLASS[_letter] = _CLASS[_letter - 32] = _letter
_IS_LETTER = _CLASS != 32
_IS_LETTER[128:] = False


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte to predict, it and the three before it; and each text's first.

    Runs of white space are one; each text begins after white space.
    """
    data, offsets = string_bytes(texts)
    data = _CLASS[data]
    space = data == 32
    before = np.zeros(len(data), bool)
    before[1:] = space[:-1]
    begins = offsets[:-1]
    before[begins[begins < len(data)]] = True
    keep = ~(space & before)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    length = np.diff(kept)
    rows = len(length)
    padded = np.full(int(kept[-1]) + rows * ORDER, 32, np.uint8)
    target = np.arange(int(kept[-1])) + np.repeat(np.arange(1, rows + 1) * ORDER, length)
    padded[target] = data[keep]
    key = padded[target].astype(np.uint32)
    for back in range(1, ORDER + 1):
        key |= padded[target - back].astype(np.uint32) << np.uint32(8 * back)
    return key, kept


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = string_bytes(texts)
    ascii_ = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])[offsets]
    found = np.diff(ascii_) > 0
    other = np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[offsets]) > 0
    for row in np.flatnonzero(~found & other).tolist():
        found[row] = any(c.isalpha() for c in texts[row].as_py())
    return found


class Level:
    """Counts of one order: for each byte after a context, by language."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count
        self.context, self.owner = np.unique(key >> np.uint32(8), return_inverse=True)
        self.total, self.distinct = self._sum(count), self._sum(count > 0)

    def _sum(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.context), values.shape[1]))
        np.add.at(sums, self.owner, values)
        return sums

    @staticmethod
    def _rows(table: np.ndarray, ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The wanted rows, zeros where a key is unknown."""
        at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        return np.where((ordered[at] == wanted)[:, None], table[at], 0)

    def seen(self, key: np.ndarray) -> np.ndarray:
        return self._rows(self.count, self.key, key)

    def at(self, table: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self._rows(table, self.context, context)


class Trees:
    """Context trees of all languages, from the counts of four bytes in a row."""

    def __init__(self, languages: list[str], key: np.ndarray, count: np.ndarray):
        self.languages = languages
        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else np.uint32(0xFFFFFFFF)
            own, owner = np.unique(key & mask, return_inverse=True)
            sums = np.zeros((len(own), len(languages)))
            np.add.at(sums, owner, count)
            self.levels.append(Level(own, sums))
        # What a context's bytes make up of the shorter context: they are excluded there.
        self.excluded = []
        for order in range(ORDER):
            upper, lower = self.levels[order + 1], self.levels[order]
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            shared = np.where(upper.count > 0, lower.seen(upper.key & mask), 0)
            self.excluded.append(upper._sum(shared))
        self.key = self.levels[ORDER].key
        self.bits = np.ascontiguousarray(self.cost(self.key).T) if len(key) else np.zeros((len(languages), 0))
        self.slot = np.zeros(_SLOTS, np.int32)
        self.slot[self._hash(self.key)] = np.arange(len(self.key))

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key * _SPREAD) >> np.uint32(12)

    def cost(self, key: np.ndarray) -> np.ndarray:
        """Bits of each key's last byte after the three before it, by language."""
        shape = (len(key), len(self.languages))
        bits, open_ = np.zeros(shape), np.ones(shape, bool)
        out_count, out_distinct = np.zeros(shape), np.zeros(shape)
        for order in reversed(range(ORDER + 1)):
            level = self.levels[order]
            mask = np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else np.uint32(0xFFFFFFFF)
            own = key & mask
            context = own >> np.uint32(8)
            count = level.seen(own)
            total, distinct = level.at(level.total, context), level.at(level.distinct, context)
            new = distinct - out_distinct
            whole = total - out_count + new
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, escape = np.log2(whole / count), np.log2(whole / new)
            found = open_ & (count > 0)
            bits += np.where(found, hit, np.where(open_ & (whole > 0), escape, 0))
            open_ &= ~found
            if order:
                out_distinct = distinct
                out_count = level.at(self.excluded[order - 1], context)
            else:
                out_distinct = distinct
        return bits + np.where(open_, np.log2(np.maximum(256 - out_distinct, 1)), 0)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        key, first = grams(texts)
        lengths = np.zeros((len(first) - 1, len(self.languages)))
        if not len(key):
            return lengths
        at = self.slot[self._hash(key)]
        miss = np.flatnonzero(self.key[at] != key)
        known = np.minimum(np.searchsorted(self.key, key[miss]), len(self.key) - 1)
        at[miss] = known
        miss, known = miss[self.key[known] != key[miss]], None
        rare, owner = np.unique(key[miss], return_inverse=True)
        extra = self.cost(rare).T
        full = np.flatnonzero(np.diff(first))
        for n in range(len(self.languages)):
            bits = self.bits[n][at]
            bits[miss] = extra[n][owner]
            lengths[full, n] = np.add.reduceat(bits, first[:-1][full])
        return lengths

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the first language in order wins a tie."""
        letters = has_letter(texts)
        if not len(self.key):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lengths = self.code_lengths(texts)
        best = lengths.argmin(axis=1)
        odds = np.exp2(np.minimum(lengths.min(axis=1)[:, None] - lengths, 0))
        score = np.where(letters, 1 / odds.sum(axis=1), 0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


#: Characters of a text that stand for a language of which no whole text was chosen.
PIECE = 20_000


def held_out(id_column: str) -> Column:
    """Rows kept from training: a quarter, by a checksum of the id; a null id is not held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id", language_bytes: int = LANGUAGE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Frozen statistics from a sample of the labelled texts, whole texts each.

    A language gives about ``language_bytes``, all together ``sample_bytes``: rows are
    chosen by a hash, at a rate that follows from the bytes the language has, so no
    language is gathered in one place.  A language of few long texts may give none; then the
    first ``PIECE`` characters of one text stand for it.  The id only spreads the choice over copies.  The counts that reach the driver are fewer than
    the sample's bytes.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"), F.col(id_column).alias("id")).dropna(subset=["text", "lang"])
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Trees([], np.zeros(0, np.uint32), np.zeros((0, 0)))
    quota = min(language_bytes, sample_bytes // len(languages))
    limit = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(limit, quota * limit // max(1, sizes[lang])))])
    chosen = labelled.filter(F.pmod(F.xxhash64("text", "lang", "id"), F.lit(limit)) < rate[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                key, first = grams(batch.column("text").slice(begin, end - begin))
                lang, place = np.unique(np.array(names[begin:end]), return_inverse=True)
                owner = np.repeat(place, np.diff(first)).astype(np.uint64)
                both, n = np.unique(owner << np.uint64(32) | key, return_counts=True)
                arrays = [pa.array(lang[(both >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    def counted(rows: DataFrame) -> pa.Table:
        return rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()

    counts = counted(chosen)
    absent = sorted(set(languages) - set(counts.column("lang").to_pylist()))
    if absent:
        # The beginning of the text with the least hash; partial minima meet before the shuffle.
        piece = F.struct(F.xxhash64("text", "id").alias("draw"), F.substring("text", 1, PIECE).alias("text"))
        floor = labelled.filter(F.col("lang").isin(absent)).groupBy("lang").agg(F.min(piece).alias("piece"))
        counts = pa.concat_tables([counts, counted(floor.select(F.col("piece.text").alias("text"), "lang"))])
    # A language that has no statistics at all, such as one of empty texts, is not learned.
    languages = sorted(set(counts.column("lang").to_pylist()))
    gram = counts.column("gram").to_numpy().astype(np.uint32)
    column = np.searchsorted(np.array(languages), np.array(counts.column("lang").to_pylist(), dtype=str))
    key, owner = np.unique(gram, return_inverse=True)
    table = np.zeros((len(key), len(languages)))
    table[owner, column] = counts.column("n").to_numpy()
    return Trees(languages, key, table)


def predict_language(docs: DataFrame, trees: Trees, text: str = "text", with_text: bool = True) -> DataFrame:
    """The documents, all columns kept (the text if ``with_text``), with ``lang_pred`` and ``score`` (0 to 1).

    The score is the language's share of the probability that all languages together
    give the text.  Null texts, texts without a letter, and all texts if nothing was
    learned are ``und`` with score 0.  Only the text is looked at.  Repeated rows and
    null ids stay as they are; an empty table gives no rows.  Columns of the result's
    names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                pred, score = held.value.predict(part.column("text"))
                out = part.column("text") if with_text else pa.nulls(len(pred), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc"), out, pa.array(pred, pa.string()), pa.array(score)], ["doc", "text", "lang_pred", "score"])

    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["doc"], packed.schema["text"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = packed.mapInArrow(scan, schema)
    kept = [(F.col("text") if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c in rest or (c == text and with_text)]
    return scored.select(*kept, "lang_pred", "score")
