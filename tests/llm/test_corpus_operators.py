"""Operators that look across rows: near-duplicates, decontamination, archives, and the pipeline, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest

import corpus_pipeline
from lamina.llm import decontaminate, near_dedup, warc
from lamina.llm.components import components


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]


def plain_components(docs, size=3, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < size else set(zip(*(w[k:] for k in range(size))))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_as_all_pairs(spark):
    rng = random.Random(8)
    docs = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one")]
    for group in range(12):
        base = words(rng, rng.choice([5, 40, 200]))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())
            docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_components(docs)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_open_buckets_in_blocks(spark, monkeypatch):
    """Many copies of one text, each altered: hub links don't reach all, blocks of few nodes must."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 120)
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(120)] = f"n{i}{rng.random()}"
        docs.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_components(docs)


def test_hot_classes_blocks_and_a_chain(spark, monkeypatch):
    """Thousands of exact copies and of empty texts, a chain of neighbours, and roots that are looked up by shuffle."""
    from lamina.llm import common, components

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 50)
    monkeypatch.setattr(components, "BROADCAST_ROOTS", 0)
    rng = random.Random(12)
    copy = " ".join(words(rng, 40))
    docs = [(i, copy) for i in range(0, 20000, 2)] + [(i, None if i % 3 else " ") for i in range(1, 20001, 2)]
    chain = words(rng, 300)
    start = len(docs)
    for i in range(60):
        chain[5 * i : 5 * i + 5] = words(rng, 5)
        docs.append((30000 + i, " ".join(chain)))
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    plain = plain_components(docs[start:])
    for i, t in docs:
        root = 0 if t == copy else i if not (t or "").split() else plain[i][1]
        assert got[i] == (root, i == root)
    assert len({root for _, root in plain.values()}) < 60


def test_repeated_and_null_ids(spark):
    text, other = " ".join(words(random.Random(1), 30)), " ".join(words(random.Random(2), 30))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, other), (5, other), (9, other)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", 5, True)] * 3 + [("7", 5, False), ("9", 5, False), ("None", 5, False), ("None", 5, False)])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long").repartition(7)
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**dict.fromkeys(range(1, 301), 0), 501: 500}


def test_leaks_and_clean_documents(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 30)) + ".") for i in range(20)] + [(90, None), (91, ""), (92, "a b")]
    filler = lambda n: " ".join(words(rng, n))
    docs, leaks = [], set()
    for i in range(120):
        text = filler(rng.randint(0, 150))
        if i % 4 == 0:
            item = items[i % 20][1]
            if i % 8 == 0:  # a paraphrase: every seventh word replaced
                item = " ".join("other" if k % 7 == 3 else w for k, w in enumerate(item.split()))
            text, _ = f"{text} {item.upper()} {filler(40)}", leaks.add((i, i % 20))
        docs.append((i, text, "c"))
    docs += [(500, None, "c"), (501, "", "c"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == leaks and found.count() == len(leaks)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_leaks_that_the_cosine_misses(spark):
    """Against a search of all stretches, at a cosine that no passage reaches."""
    rng = random.Random(9)
    pool = words(rng, 60)
    items = [rng.choices(pool, k=rng.choice([5, 12, 30, 70])) for _ in range(12)]
    docs = []
    for i in range(80):
        part = list(items[i % 12])
        for _ in range(rng.randint(0, len(part) * 2 // 5)):
            part[rng.randrange(len(part))] = rng.choice(pool + ["other"])
        docs.append(rng.choices(pool, k=rng.randint(0, 300)) + part * rng.randint(0, 1) + rng.choices(pool, k=rng.randint(0, 60)))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1] / len(a)

    for item in items:  # at the end of a window, behind other words
        ids = [pool.index(w) for w in item]
        assert decontaminate._compact_share(decontaminate._masks(ids), len(ids), [-1] * 2 * len(ids) + ids + [-1] * 3) == 1.0
    truth = {}
    for d, text in enumerate(docs):
        for q, item in enumerate(items):
            if (most := common(item, text)) >= 0.7:
                best = max(common(item, text[k : k + 2 * len(item)]) for k in range(len(text)))
                if best >= 0.7:
                    truth[d, q] = best
                assert best <= most
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(q, " ".join(i)) for q, i in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench, cosine=1.01).collect()}
    assert {k: r.common for k, r in found.items() if r.common >= 0.7} == truth and len(truth) > 20
    assert all(r.answer for r in found.values() if r.common < 0.7)


def test_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontaminate.common_length(masks, len(a), b) == table[-1][-1]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    rows = [(1, "http://a/ü x", "<p>one</p>", 0), (2, None, None, 0), (3, "http://b", "", 0), (4, "http://c", "<p>one</p>", 0), (5, "http://d", "é" * 2000, 0), (4, "http://c", "<p>one</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3)
    index = warc.write_archives(pages)
    got = sorted(map(tuple, warc.read_archives(index).collect()), key=str)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {h or "": max(i for i, _, x, _ in rows if (x or "") == (h or "")) for _, _, h, _ in rows}
    expected = [(i, len((h or "").encode()), digest(h), *(("response", None) if largest[h or ""] == i else ("revisit", largest[h or ""]))) for i, _, h, _ in rows]
    assert got == sorted(expected, key=str)
    record = warc.read_records(index.filter("page_id = 5")).collect()[0].record
    head, block = next(warc.parse_records(bytes(record)))
    assert head["X-Page-Id"] == "5" and block.endswith(("é" * 2000).encode())
    bundles = index.select("bundle").distinct().count()
    assert bundles > 1 and warc.read_archives(index).rdd.getNumPartitions() == bundles
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == got
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline_against_plain_stages(spark):
    """At the smallest scale: what the stages keep follows from each operator's own (tested) verdict on its predecessor's rows."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    known = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        known.append({r.doc_id: r.text for r in docs.collect()})
    quality, dedup, clean, private = known
    groups = plain_components(sorted(quality.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert set(dedup) == {i for i, (_, root) in groups.items() if root == i}
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    holds = lambda t: any(b" " + b" ".join(i) + b" " in b" " + b" ".join(decontaminate.words(t)) + b" " for i in items)
    assert not any(map(holds, clean.values())) and all(holds(dedup[i]) for i in set(dedup) - set(clean))
    assert set(private) == set(clean) and not any("@mail" in t for t in private.values())
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in private.items()}
