"""Decontamination, the parity join and components against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docloom.llm import decontaminate, parity_join
from docloom.llm.components import components
from docloom.llm.decontaminate import find_contamination, remove_contamination
from docloom.llm.parity_join import Bands, similar_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def groups(sets, least=85, part=100):
    """Least place reachable by links, for each place."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and part * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("least", "seed"), [(85, 1), (60, 2), (95, 3)])
def test_similar_sets_match_brute_force(spark, least, seed):
    rng = random.Random(seed)
    texts = []
    for n in [1, 2, 3, 4, 5, 8, 15, 30, 60, 120, 300, 900]:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for share in [0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2]:
            edited = [w if rng.random() >= share else f"v{rng.randrange(400)}" for w in base]
            texts.append(" ".join(edited + [f"tail{rng.randrange(3)}"] * rng.randrange(2)))
    texts += ["", None, "  "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets(docs, least=least).collect()}
    sets = [shingles(t) for t in texts]
    want = {i: (len(sets[i]), g) for i, g in enumerate(groups(sets, least))}
    assert got == want


def test_the_pipelines_stage_matches_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(4):
        long_, short = line(200), line(50)
        texts += [long_, long_[:165], short, [*short[:25], "changed", *short[26:]]]
    for n in [4, 5, 6, 20, 60, 150, 400]:
        base = line(n)
        for share in [0, 0.01, 0.02, 0.03, 0.04, 0.06]:
            texts.append([w if rng.random() >= share else "v" for w in base])
            texts.append(base[: round(n * (1 - 4 * share))])
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t, 5) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    assert sum(0.80 <= s < 0.85 for s in similar) > 8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.similar_documents(spark, docs, "").collect()}
    assert kept == set(groups(sets, 80))


def test_a_chain_and_a_large_group_are_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    # Neighbours differ in one word; the ends do not link directly.
    chain = [" ".join([f"x{j}" if j < k else w for j, w in enumerate(base)]) for k in range(0, 120, 3)]
    copies = [" ".join(base + [f"own{k}"]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(chain + copies)), "doc_id long, text string")
    sets = [shingles(t) for t in chain + copies]
    got = {r.doc_id: r.component_id for r in similar_sets(docs).collect()}
    assert got == dict(enumerate(groups(sets)))
    assert set(got.values()) == {0}


def test_bands_allow_every_linked_pair():
    bands = Bands()
    edges = bands.upto(5000)
    for a in [*range(1, 400), 777, 1234, 3000]:
        band = int(np.searchsorted(edges, a, side="right")) - 1
        for b in range(a, a * 100 // 85 + 1):
            assert np.searchsorted(edges, b, side="right") - 1 <= band + 1
            shared = -(-85 * (a + b) // 185)
            assert a + b - 2 * shared <= bands.difference(band)


def test_similar_sets_on_edge_rows(edge, edge_rows, empty):
    rows = similar_sets(edge).collect()
    assert len(rows) == len(edge_rows)
    sets = [shingles(r[1]) for r in edge_rows]
    roots = groups(sets)
    ids = {}
    for r, g in zip(edge_rows, roots, strict=True):
        if r[0] is not None:
            ids[g] = min(ids.get(g, r[0]), r[0])
    want = sorted(((r[0], len(s), ids.get(g) if s else r[0]) for r, s, g in zip(edge_rows, sets, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
    assert similar_sets(empty).count() == 0


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (None, 1), (9, 8), (8, 7), (4, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 7)}
    assert components(links.filter("false")).count() == 0


def contamination(texts, items, window=10):
    phrases = {}
    for item, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(p) for p in phrases}
    out = []
    for text in texts:
        found = list(TERM.finditer((text or "").translate(LOWER)))
        w = [m[0] for m in found]
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit.update(range(i, i + n))
                    named |= phrases[p]
        spans, last = [], None
        for i in sorted(hit):
            if last is not None and i == last + 1:
                spans[-1] = (spans[-1][0], found[i].end())
            else:
                spans.append(found[i].span())
            last = i
        out.append((len(w), len(hit), sorted(str(n) for n in named if n is not None), spans))
    return out


ITEMS = [(1, "to be or not to be that is the question"), (2, "short one"), (3, "Über naïve 日本"), (4, None), (5, ""), (6, "..."), (None, "two words"), (2, "another text"), (7, "a b c d e f g h i j k l"), (8, "b c d e f g h i j k")]


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_contamination_matches_brute_force(spark, edge, edge_rows, empty, block_words):
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows] + ["x a b c d e f g h i j k l m a b c d e f g h i j", "To be, or not to be: that is the question! short-one", "日本 Über naïve 日本"]
    texts += [" ".join(rng.choice("abcdefghijkl") for _ in range(200)) + " a b c d e f g h i j k" for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [(s.begin, s.end) for s in r.spans]) for r in find_contamination(docs, items, block_words=block_words).collect()}
    assert got == dict(enumerate(contamination(texts, ITEMS)))
    assert sum(n[1] > 0 for n in got.values()) > 3
    cleaned = {r.doc_id: r.text for r in remove_contamination(docs, items, block_words=block_words).collect()}
    for i, (text, (_, _, _, spans)) in enumerate(zip(texts, contamination(texts, ITEMS), strict=True)):
        for begin, end in reversed(spans):
            text = text[:begin] + text[end:]
        assert cleaned[i] == text
    if block_words > 3:
        assert remove_contamination(edge, items).columns == edge.columns
        assert remove_contamination(edge, items).count() == len(edge_rows)
        assert find_contamination(empty, items).count() == 0
        none = find_contamination(edge, items.filter("false")).collect()
        assert len(none) == len(edge_rows)
        assert not any(r.n_hit for r in none)


def test_contamination_is_one_pass_over_the_texts(spark):
    """One Python node and one index a slice however many blocks; blocks that are not kept are read again."""
    rng = random.Random(5)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(12))) for i in range(40)]
    texts = [f"start {items[i % 40][1]} {items[(i * 7) % 40][1]} end" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=24)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [(s.begin, s.end) for s in r.spans]) for r in found.collect()}
    assert got == dict(enumerate(contamination(texts, items)))


def test_blocks_beyond_what_a_task_keeps_are_read_again(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(30)], "item_id long, text string")
    files = decontaminate.phrase_blocks(items, "text", "item_id", 10, 5)
    whole = sorted(len(b.hashes) for b in decontaminate.Blocks(files))
    monkeypatch.setattr(decontaminate, "KEPT_BYTES", 500)
    blocks = decontaminate.Blocks(files)
    assert [sorted(len(b.hashes) for b in blocks) for _ in range(2)] == [whole] * 2
    assert blocks.kept is None
    assert sum(whole) == 90


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    """Chains of near copies that do not link to their middle, around passages that all share."""
    monkeypatch.setattr(parity_join, "CELL", 7)
    monkeypatch.setattr(parity_join, "CELL_SHINGLES", 900)
    rng = random.Random(11)
    common = [f"c{rng.randrange(40)}" for _ in range(30)]
    texts = []
    for n in (40, 90, 200):
        text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(90):
            text = list(text)
            for _ in range(max(1, n // 60)):
                text[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(text[: n // 2] + common[: rng.randrange(4) * n // 40] + text[n // 2 :]))
    texts += [" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for width, least in ((4, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in similar_sets(docs, width=width, least=least).collect()}
        assert got == dict(enumerate(groups([shingles(t, width) for t in texts], least)))


def test_any_order_of_keys_loses_no_link(spark, monkeypatch):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > 0.02 else "v" for w in b) for b in base for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(groups([shingles(t) for t in texts])))
    for times in (1, 10**9):
        monkeypatch.setattr(parity_join, "FREQUENT", times)
        assert {r.doc_id: r.component_id for r in similar_sets(docs).collect()} == want


def test_sets_of_many_texts_take_little_memory():
    """A worker holds the arrays of a part of a batch, not of all of it."""
    import tracemalloc

    words = [f"w{n * 7919 % 100_003}" for n in range(400)]
    texts = pa.array([" ".join(words[i % 300 :]) + f" {i}" for i in range(2000)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    tracemalloc.start()
    sizes = [np.diff(parity_join._sets(part.column("text"))[1]).tolist() for part in parity_join._slices_of([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes, []) == np.diff(parity_join._sets(texts)[1]).tolist()
    assert peak < 60e6, peak


def test_sets_without_a_common_shingle_share_no_key():
    """Chance keys would grow with the square of the table; blocks of one shingle are the ones to watch."""
    sets, size = 3000, 60
    shingle = np.concatenate([np.sort(np.random.default_rng(n).integers(0, (1 << 64) - 1, size, dtype=np.uint64)) for n in range(sets)])
    assert len(np.unique(shingle)) == sets * size
    for bands in (Bands(85, 100), Bands(80, 100)):
        # Sets whose zeros are keys too share those; the others have only keys of their shingles.
        key, row = parity_join._keys(shingle, np.arange(0, sets * size + 1, size), bands)
        blocks = sum(bands.blocks(int(np.searchsorted(bands.upto(size), size, side="right")) - 1 - k)[0] for k in (0, 1))
        absent = {int(k) for g in range(40) for k in parity_join.mixed(np.uint64(1) + parity_join.mixed(np.uint64(g << 32) + np.arange(blocks, dtype=np.uint64))).view(np.int64)}
        own = np.array([k for k in key.tolist() if k not in absent])
        assert len(own) > 20 * sets
        assert len(np.unique(own)) == len(own)
