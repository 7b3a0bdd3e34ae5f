"""Exact dedup, the Merkle manifest and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, merkle, queries, whitening
from docloom.llm.exact_dedup import exact_duplicates
from docloom.llm.merkle import fold, leaf_digest, lower_ascii, manifest
from docloom.llm.whitening import fixed_point, whiten


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- exact dedup ---------------------------------------------------------------------------


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def want_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        first = min(groups[plain(t)])
        own = (-len(t or ""), i is None, i or 0, i)
        out.append((i, first[3], len(groups[plain(t)]), own == first, h(plain(t))))
    return sorted(out, key=str)


def got_duplicates(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in exact_duplicates(df).collect()], key=str)


def test_exact_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "bb", "é", "日本", "ab", "ba", " ", " ", " "]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "\n", "\t \r", "\v\f"]) for _ in range(rng.randrange(6))) for _ in range(600)]
    # Equal lengths and beginnings, other ends; and the reverse.
    texts += ["x" * 80 + str(i % 7) for i in range(60)] + [str(i % 7) + " x" * 80 for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got_duplicates(df) == want_duplicates(rows)


def test_flags_that_are_full_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 2)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 2)
    rows = [(i, f"text {i % 50} {'y' * (i % 9)}") for i in range(300)]
    assert got_duplicates(spark.createDataFrame(rows, "doc_id long, text string")) == want_duplicates(rows)


def test_exact_duplicates_edge_rows(spark, edge, edge_rows, empty):
    assert got_duplicates(edge) == want_duplicates([(r[0], r[1]) for r in edge_rows])
    found = exact_duplicates(edge.withColumns({c: F.lit("taken") for c in ("kept", "keep_id", "size", "n", "norm", "again", "c0", "beginning", "_word")}))
    assert found.columns == [*edge.columns, "size", "n", "norm", "again", "c0", "beginning", "_word", "keep_id", "group_size", "kept", "digest"]
    assert {(r["size"], r.n, r.c0, r.again) for r in found.collect()} == {("taken",) * 4}
    assert exact_duplicates(empty).count() == 0
    strings = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {r.keep_id for r in exact_duplicates(strings).collect()} == {"a"}


# -- Merkle manifest -----------------------------------------------------------------------


def brute_manifest(rows, columns=("doc_id", "lang", "text")):
    """rows: dicts; (doc_id, leaf, subroot, root, proof, folded) by lists of whole levels."""

    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return h(*[framed(r[c]) for c in columns])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(all_levels, i):
        found = []
        for level in all_levels[:-1]:
            b = i // 8 * 8
            found.append((level[b:i], level[i + 1 : b + 8]))
            i //= 8
        return found

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    held = {t: levels([k[2] for k, _ in sorted(trees[t], key=lambda x: x[0])]) for t in order}
    top = levels([held[t][-1][0] for t in order])
    out = []
    for place, t in enumerate(order):
        for i, (key, r) in enumerate(sorted(trees[t], key=lambda x: x[0])):
            path = siblings(held[t], i) + siblings(top, place)
            text = r["text"]
            lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            digest = leaf({**r, "text": lowered}) if tampered else key[2]
            for left, right in path:
                digest = h(*left, digest, *right)
            out.append((r["doc_id"], key[2], held[t][-1][0], top[-1][0], [x for left, right in path for x in left + right], digest))
    return sorted(out, key=str)


def got_manifest(df, columns=("doc_id", "lang", "text"), rounds=merkle.BLOCK_LEVELS):
    changed = leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(df, list(columns), shown=F.when(chosen, changed), rounds=rounds).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    assert all(fold(r.leaf, r.proof, r.slots, r.widths) == r.root for r in rows)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in rows], key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "fr": 9}, {"en": 4097, None: 513, "de": 512, "": 64, "x": 1}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_manifest_matches_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [{"doc_id": rng.randrange(10**12), "lang": lang, "text": f"Text É {rng.random()}" if i % 3 else "plain A"} for lang, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, lang string, text string").repartition(5)
    assert got_manifest(df) == brute_manifest(rows)


def test_manifest_with_small_superblocks(spark):
    rows = [{"doc_id": i, "lang": "en" if i % 40 else "fr", "text": f"T{i}"} for i in range(1200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, lang string, text string")
    assert got_manifest(df, rounds=1) == brute_manifest(rows)


def test_manifest_edge_rows(spark, edge, edge_rows, empty):
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in edge_rows]
    df = edge.withColumns({c: F.lit("taken") for c in ("tree", "position", "shown", "row", "size", "_id")})
    assert got_manifest(df, columns) == brute_manifest(rows, columns)
    assert manifest(empty, list(columns)).count() == 0
    assert manifest(edge, list(columns)).filter("not verified").count() == 0


# -- whitening -----------------------------------------------------------------------------


def check_whitening(rows, vectors, components=8):
    """rows of the operator against numpy, where ``vectors`` maps ids to whole numbers."""
    x = np.array([v for v in vectors.values()], dtype=object)
    n = len(x)
    sums = x.sum(axis=0)
    centred = np.array([[float(a) for a in r] for r in x]) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    assert len(rows) == n
    white = {r.vec_id: np.array(r.whitened) for r in rows}
    got = np.stack([white[i] for i in vectors])
    want = centred @ axes[:, : got.shape[1]] / np.sqrt(values[: got.shape[1]])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-7)
    total = np.trace(centred.T @ centred / n)
    for r in rows:
        assert r.n == n and np.allclose(r.explained, values[: len(r.explained)] / total, rtol=1e-9)
        assert int(r.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(vectors[r.vec_id], sums, strict=True))
        assert r.identity_error < 1e-6
    assert np.abs(np.cov(got.T, bias=True) - np.eye(got.shape[1])).max() < 1e-6


@pytest.mark.parametrize(("rows", "dims", "block"), [(400, 12, 1024), (900, 5, 32), (60, 3, 8)])
def test_whitening_matches_numpy(spark, monkeypatch, rows, dims, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = np.random.default_rng(rows)
    data = rng.normal(size=(rows, dims)) * rng.uniform(0.05, 3, dims)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(6)
    vectors = {i: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for i, v in enumerate(data)}
    check_whitening(whiten(fixed_point(frame)).collect(), vectors)


def test_whitening_in_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    data = np.random.default_rng(1).integers(-500, 500, (100, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<long>")
    check_whitening(whiten(frame).collect(), dict(enumerate(data.tolist())))


def test_whitening_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 0.0, 0.0]), (54, [0.0, inf, 0.0]), (55, [0.0, -inf, 0.0]), (56, [1.0, 2.0])]
    twins = [(None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, good[3][1])]
    frame = spark.createDataFrame([(*r, "t", 1) for r in good + bad + twins], "vec_id long, embedding array<float>, index string, n int")
    rows = whiten(fixed_point(frame)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in good + twins)
    # The third dimension has no variance, so two components are left.
    assert {len(r.whitened) for r in rows} == {2} and {r.n for r in rows} == {43}
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.n, int(r.deviation), r.whitened) for r in whiten(fixed_point(same)).collect()] == [(2, 0, [])] * 2
    assert whiten(fixed_point(same.limit(0))).count() == 0


def test_whitening_query_has_one_row_a_component(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op11_whitening"](spark, folder).collect()
    assert len(rows) == 8 * spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert {r.component for r in rows} == set(range(1, 9)) and rows[0].identity_error < 1e-4
