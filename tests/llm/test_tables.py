"""Web archives, mixing, line dedup and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, connect
from docloom.llm import language_id, line_dedup, web_records
from docloom.llm.mixing import find_exponent, mix_sources
from docloom.llm.queries import ORACLES, QUERIES

PAGES = "page_id long, url string, html string, payload string, digest string, kind string"


def page_rows():
    big, other = "<p>ü" + "x" * 1500 + "</p>", "y" * 999
    rng = random.Random(2)
    long_ = "".join(rng.choice("abc \n\r") for _ in range(200_000))
    rows = [(1, "u1", big), (7, "u7", big), (3, "u3", big), (4, None, other), (5, "u5", other), (6, "a\r\nb", None), (8, "", ""), (9, "u", "z" * 1000), (10, "u", "WARC/1.1\r\n\r\n\r\n" * 100)]
    rows += [(11, "u", long_), (12, "u", long_), (12, "u", long_), (None, "u", big), (None, None, "q" * 2000), (13, "u", "body\r\n\r\n"), (7, "again", big)]
    return [(*r, "p", None, "k") for r in rows]


def test_pages_come_back(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = str(tmp_path / "warc")
    web_records.write_pages(pages, folder, segment_bytes=5000, chunk_bytes=700)
    records = web_records.resolve_revisits(web_records.read_pages(spark, folder)).collect()
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    last = {}
    for page, body in payloads:
        if len(body) >= 1000 and page is not None:
            last[body] = max(page, last.get(body, page))
    want = []
    for page, body in payloads:
        again = len(body) >= 1000 and body in last and page != last[body]
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[body] if again else None))
    got = [(r.page_id and int(r.page_id), r.n_bytes, r.digest, r.kind, r.refers_to_page and int(r.refers_to_page)) for r in records]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.error for r in records} == {None}
    bodies = Counter(bytes(r.payload) for r in records if r.kind == "response")
    assert bodies == Counter(b for (_, b), w in zip(payloads, want, strict=True) if w[3] == "response")


def test_archives_stay_valid_and_faults_are_named(spark, tmp_path):
    folder = str(tmp_path / "warc")
    web_records.write_pages(spark.createDataFrame(page_rows()[9:11], PAGES), folder, segment_bytes=5000, compression="none")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "warc").glob("part-*")))
    records = list(web_records.parse_archive(data))
    assert list(web_records.parse_archive(gzip.compress(data))) == records
    assert all(r["error"] is None for r in records)
    assert {r["kind"] for r in records} == {"response", "revisit", "continuation"}
    assert [r["error"] for r in web_records.parse_archive(data[:-30])][-1] == "record cut short"
    assert [r["error"] for r in web_records.parse_archive(b"nonsense")] == ["no record header"]
    frame = spark.createDataFrame([tuple(r[n] for n in web_records._SEGMENT_ARROW.names) for r in records if r["number"] and r["number"] != 3], web_records.SEGMENT)
    assert {r.error for r in web_records.reassemble(frame).collect()} == {"segments missing"}
    assert web_records.dechunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for broken in (b"3\r\nab", b"zz\r\n", b"", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            web_records.dechunk(broken)


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "warc")
    web_records.write_pages(spark.createDataFrame([], PAGES), folder)
    assert web_records.read_pages(spark, folder).count() == 0


# -- mixing ------------------------------------------------------------------------------


def shares(totals, exponent):
    whole = sum(totals.values())
    powers = {s: (n / whole) ** exponent for s, n in totals.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


@pytest.mark.parametrize("target", [{"entropy": 1.2}, {"repetitions": 3.0}, {"entropy": 9.0}, {"repetitions": 0.5}])
def test_the_exponent_meets_its_target(spark, target):
    totals = {"a": 6000, "b": 900, "c": 100, "d": 40}
    frame = spark.createDataFrame(list(totals.items()), "source string, n long")
    exponent = find_exponent(frame, **target)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        w = shares(totals, mid)
        if "entropy" in target:
            flat = -sum(p * math.log2(p) for p in w.values()) > target["entropy"]
        else:
            flat = max(w[s] * sum(totals.values()) / totals[s] for s in w) > target["repetitions"]
        low, high = (mid, high) if flat else (low, mid)
    assert exponent == pytest.approx(high, abs=1e-6)


def test_copies_fill_each_budget(spark):
    rng = random.Random(4)
    sizes = {"hot": 4000, "b": 300, "c": 60, None: 200}
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc, " ".join(["w"] * rng.randrange(0, 40)), source, "clash"))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    mixed = mix_sources(docs, repetitions=3.0, block_tokens=500).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(doc))
    total = sum(r.n_tokens for r in mixed)
    assert {r.doc_id: r.n_tokens for r in mixed} == {r[0]: len(r[1].split()) for r in rows}
    by = defaultdict(list)
    for r in mixed:
        by[r.source].append(r)
    assert sum(rs[0].weight for rs in by.values()) == pytest.approx(1)
    for rs in by.values():
        n, budget = sum(r.n_tokens for r in rs), rs[0].weight * total
        drawn = sum(r.n_tokens * r.copies for r in rs)
        assert budget - 1 <= drawn <= budget + 40
        assert {r.copies for r in rs} <= {int(budget // n), int(budget // n) + 1}
        assert budget / n <= 3.0 + 1e-6
        # The documents drawn once more are the beginning of the permutation.
        extra = [r.position for r in rs if r.copies > budget // n and r.n_tokens]
        rest = [r.position for r in rs if r.copies <= budget // n and r.n_tokens]
        assert not extra or not rest or max(extra) <= min(rest)


def test_documents_without_tokens_enter_no_block(spark):
    rows = [(i, "" if i % 3 else "one two three", "a" if i % 2 else "b", None) for i in range(600)]
    rows += [(1000 + i, None, "silent", None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mix_sources(docs, repetitions=2.0, block_tokens=50).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert (r.position is None) == (r.n_tokens == 0)
        assert (r.weight is None) == (r.source == "silent")
        assert r.source != "silent" or r.copies == 0
    whole = {s: min(r.copies for r in got if r.source == s) for s in "ab"}
    assert all(r.copies == whole[r.source] for r in got if r.source in whole and not r.n_tokens)


def test_mixing_edge_rows(edge, edge_rows, empty):
    assert mix_sources(edge, entropy=1.0).count() == len(edge_rows)
    assert mix_sources(empty, entropy=1.0).count() == 0
    with pytest.raises(ValueError):
        mix_sources(edge)


# -- line dedup --------------------------------------------------------------------------


def brute_lines(rows, cuts=line_dedup.CUTS):
    """Chunks of one text at a time by the operator's cut, first places and removal by dictionaries."""
    import pyarrow as pa

    def order(row):
        return (row[0] is None, row[0] if row[0] is not None else 0, row[2], row[3])

    places = defaultdict(set)
    for row in rows:
        if row[1]:
            for h, _, at, n, before, after in zip(*(a.tolist() for a in line_dedup.chunks(pa.array([row[1]]), cuts)), strict=True):
                places[h].add((order(row), at, n, row[1], before, after))
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n") if row[1] else []
        gone = set()
        for found in places.values():
            first = min(found)
            source = first[3].split("\n")
            for o, at, n, text, _, _ in found:
                if text != row[1] or o != order(row) or (o, at) == first[:2]:
                    continue
                assert lines[at : at + n] == source[first[1] : first[1] + n]
                low, high, a, b = at, at + n, first[1], first[1] + n
                while low and at - low < first[4] and lines[low - 1] == source[a - 1]:
                    low, a = low - 1, a - 1
                while high < len(lines) and high - at - n < first[5] and lines[high] == source[b]:
                    high, b = high + 1, b + 1
                gone |= set(range(low, high))
        kept = [line for i, line in enumerate(lines) if i not in gone]
        out.append((row[0], "\n".join(kept) if gone else row[1], len(lines), len(gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    passages = [[line(rng.choice([3, 8, 30])) for _ in range(rng.choice([1, 3, 6, 12]))] for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [[line(rng.choice([2, 6, 25])) for _ in range(rng.randrange(1, 5))]]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), [line(5)] * rng.randrange(0, 3)]
        texts.append("\n".join(x for p in parts for x in p))
    texts += ["", None, "\n\n", texts[0], texts[1] + "\n"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, doc string, key int").repartition(4)
    keyed = {r.id: (r.key, r.twin) for r in line_dedup._keyed(docs, "text", "doc_id").collect()}
    result = line_dedup.drop_repeated_lines(docs)
    assert result.columns == [*docs.columns, "n_lines", "n_removed"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in result.collect())
    want = brute_lines([(i, t, *keyed[i]) for i, t in enumerate(texts)])
    assert got == want
    # Whatever goes stays somewhere, and long passages go from all but their first place.
    left = Counter(x for _, t, _, _ in got for x in (t or "").split("\n"))
    assert all(left[x] for t in texts for x in (t or "").split("\n") if x)
    for p in passages:
        if sum(len(x.split()) for x in p) > 50:
            assert all(left[x] == 1 for x in p if len(x.split()) >= line_dedup.LONG_WORDS)


def shared_lines(texts):
    """Lines with words that stand in a passage an earlier place has too, by all pairs of places."""
    lines = [(d, x) for d, t in enumerate(texts) for x in t.split("\n")]
    n = [len(x.split()) for _, x in lines]
    places = defaultdict(list)
    for k, (_, x) in enumerate(lines):
        places[x].append(k)
    gone = set()
    for k, (d, x) in enumerate(lines):
        for j in places[x]:
            if j >= k:
                break
            if k and j and lines[k - 1] == (d, lines[j - 1][1]) and lines[j - 1][0] == lines[j][0]:
                continue
            size = 1
            while k + size < len(lines) and lines[k + size] == (d, lines[j + size][1]) and lines[j + size][0] == lines[j][0]:
                size += 1
            if size >= 2 and sum(n[k : k + size]) >= 10:
                gone |= set(range(k, k + size))
            else:
                gone |= {i for i in range(k, k + size) if n[i] >= 20}
    left = defaultdict(list)
    for k, (d, x) in enumerate(lines):
        if n[k] and k not in gone:
            left[d].append(x)
    return [left[d] for d in range(len(texts))]


def test_line_dedup_finds_every_planted_passage(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts, planted = [], []
    for size, n in [(3, 18), (4, 13), (5, 11), (2, 5), (12, 1), (3, 4)] * 8 + [(1000, 1)]:
        passage = [line(n) for _ in range(size)]
        for _ in range(2):
            around = [[line(rng.choice([1, 3, 6, 30])) for _ in range(rng.randrange(4))] for _ in range(2)]
            texts.append("\n".join([*around[0], *passage, *around[1]]))
        planted.append(passage)
    # Few different lines, blank ones too: passages that overlap and meet in parts only.
    few = [line(n) for n in [1, 1, 2, 4, 6, 9, 12, 19, 20]] + ["", " "]
    texts += ["\n".join(rng.choice(few) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.text for r in line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()]
    left = Counter(x for t in got for x in t.split("\n"))
    assert all(left[x] == 1 for p in planted for x in p)
    assert [[x for x in t.split("\n") if x.split()] for t in got] == shared_lines(texts)


def test_line_dedup_edge_rows(edge, edge_rows, empty):
    rows = line_dedup.drop_repeated_lines(edge).collect()
    assert len(rows) == len(edge_rows)
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    equal = [r.n_removed for r in rows if r.doc_id == 2]
    assert len(set(equal)) == 1


# -- queries and the pipeline --------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if name in ORACLES:
        assert compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name])[1] is None
    elif name != "op11_whitening":  # a row for each component, see test_new_tables
        table = "pages" if name.startswith("op6") else "documents"
        assert QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.select("doc_id", "text").collect()
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns, name
        assert kept.filter(F.col("n_chars") != F.length("text")).count() == 0
        assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before}
    again = corpus_pipeline.decontamination(spark, kept, folder)
    assert sorted(again.select("doc_id", "text").collect()) == sorted(kept.select("doc_id", "text").collect())
    mixed = corpus_pipeline.run(spark, folder)
    rows = mixed.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()}
    # What is drawn meets the weights, to a document of each source.
    budget = sum(len((r.text or "").split()) for r in kept.collect())
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.n_tokens for r in own) - own[0].weight * budget) <= max(r.n_tokens for r in own) + 1
    assert all(1 <= r.copy <= r.copies for r in rows) and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert kept.count() > 0.7 * docs.count()


def test_pipeline_stages_on_edge_rows(spark, edge, empty):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
        stage(spark, edge, folder).count()
    groups = corpus_pipeline.similar_documents(spark, edge, folder)
    texts = [r.text for r in groups.collect() if r.text and len(r.text.split()) > 50]
    assert len(texts) == len(set(texts))


def test_pipeline_keeps_other_columns(spark, edge):
    folder = "/root/testdata/sf0.001"
    names = ["_row", "_before", "n_lines", "n_removed", "lang_pred", "score", "key", "a b", "other column 3"]
    docs = edge.dropDuplicates(["doc_id"]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in [*names, "weight"]})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder).collect()
        assert rows, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names if r.doc_id is not None), name
    assert isinstance(rows[0].weight, float)


def test_languages_of_few_long_texts(spark):
    words = {"en": "the people of this house are not at home ", "fr": "les gens de cette maison ne sont pas chez eux ", "el": "οι άνθρωποι αυτού του σπιτιού δεν είναι εδώ "}
    rows = [(i, words[lang] * 3, lang) for lang in ("en", "fr") for i in range(200)] + [(900 + i, words["el"] * 4000, "el") for i in range(3)] + [(999, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.train(docs, language_bytes=5000)
    assert trees.languages == ["el", "en", "fr"]
    texts = [words["el"], words["fr"], words["en"]]
    found = language_id.predict_language(spark.createDataFrame([(t,) for t in texts], "text string"), trees).collect()
    assert {r.text: r.lang_pred for r in found} == {words["el"]: "el", words["fr"]: "fr", words["en"]: "en"}
