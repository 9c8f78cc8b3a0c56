"""Operators on single texts against brute force, libraries and round trips, with nulls, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from tokenizers import Tokenizer

from lamina.llm import bpe, html_extract, license_scan, pii, pretokens, quality_classifier, quality_rules, token_counts

SCHEMA = "doc_id long, text string, n_words string, kept string, spans string, score string"


def frame(spark, texts):
    rows = [(i, t, "x", "y", "z", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[0], *"abcd")] if rows else [], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def fuzz(alphabet, n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_rules_count_as_brute_force(spark):
    texts = [None, "", " \n\t", "a b", "one two three one two three", "x y z " * 40, "l\nl\n\nl #1", "word " * 3, *fuzz(["a ", "b ", "the ", "\n", "#", " ", "é ", "\t"], 60, 150, 1)]
    got = by_id(quality_rules.apply_rules(frame(spark, texts)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = list(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), t
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    assert quality_rules.apply_rules(frame(spark, texts)).count() == len(texts) + 2


ALPHABET = list("abstmdlrve''' \n\t12é³漢ñ!?., ") + ["\u0085", "　", "\x00", "\U0001f600", "́", "\U000105c0", "'ll", "<|endoftext|>", "  "]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})


def test_bpe_is_the_library(encoding):
    texts = ["", "a" * 3000, " " * 500 + "x", "'s", "\n's", *fuzz(ALPHABET, 1500, 40, 2)]
    encoder, decoder = bpe.Encoder(), bpe.Decoder()
    for t, packed in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == encoding.encode_ordinary(t)
        assert decoder.decode(ids, decoder.offsets(ids)) == t.encode()


def test_counts_are_the_library():
    texts = ["", "a" * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|>'s", *fuzz(ALPHABET, 1500, 40, 3)]
    library = Tokenizer.from_file(token_counts.VOCABULARY)
    assert token_counts.Counter().count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_boundary_scan_crosses_blocks():
    text = "'s" * 400 + " " * 700 + "x" + "!" * 300
    pieces, counts = pretokens.split([text, "", text])
    assert "".join(pieces) == text * 2 and counts.tolist() == [702 - 702 + len(pieces) // 2, 0, len(pieces) // 2]
    assert pieces[:400] == ["'s"] * 400


def test_token_tables(spark):
    texts = ["Hello world", None, ""]
    got = by_id(bpe.digests(frame(spark, texts)))
    assert got[0].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest() and got[1].n_tokens == 0
    counts = by_id(token_counts.count_tokens(frame(spark, texts)))
    assert (counts[0].n_tokens, counts[0].n_bytes, counts[1].n_tokens, counts[0].over_limit) == (2, 11, 0, False)
    assert bpe.digests(frame(spark, [])).count() == 0 and token_counts.count_tokens(frame(spark, [])).count() == 0


def test_bpe_round_trip_in_one_worker(spark, monkeypatch):
    """One Python worker a task, slice by slice, with the rows of encoding and decoding apart."""
    texts = ["Hello world", None, "", "漢字 é\n" * 40, "", *fuzz(ALPHABET, 300, 40, 5), "x" * 5000, ""]
    df = frame(spark, texts)
    assert bpe.digests(df)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    columns = "doc_id", "n_tokens", "ids", "decoded"
    apart, at_once = by_id(bpe.decode(bpe.encode(df)).select(*columns)), by_id(bpe.round_trip(df).select(*columns))
    assert apart == at_once and {i: bytes(r.decoded).decode() for i, r in at_once.items()} == {None: texts[0]} | {i: t or "" for i, t in enumerate(texts)}
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": [t or "" for t in texts]})
    whole = pretokens.slices
    monkeypatch.setattr(pretokens, "slices", lambda column: whole(column, 200))
    parts = list(bpe._decoded(bpe._encoded([batch], bpe.VOCABULARY), bpe.VOCABULARY))
    assert len(parts) > 20 and all(p.num_rows == 1 or sum(map(len, p.column("decoded").to_pylist())) <= 200 for p in parts)
    assert [r for p in parts for r in p.to_pylist()] == [at_once[i].asDict() for i in range(len(texts))]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    digits = re.sub("[^0-9]", "", m)
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base_is_the_plain_patterns(spark):
    bits = ["1", "25", "0", "4111111111111111", "4111 1111 1111 1111", ".", "-", " ", "@", "a", "b.c", "a@b.c", "+", "(", "é", "\U0001f600", "+1 (255) 555-8013", "1.2.3.4", "_"]
    texts = [None, "", "1" * 3000, "a" * 5000 + "@" + "b." * 1000 + "c", "0001.2.3.4 256.1.1.1", *fuzz(bits, 300, 20, 4)]
    got = by_id(pii.report(frame(spark, texts)))
    for i, t in enumerate(texts):
        expected = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term:")] == expected
        assert got[i].base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()


def test_pii_terms_that_reveal(spark):
    texts = [f"agent Falconridge wrote to ann@x.org on day {i} about weather" for i in range(3)] + [f"weather and agent number {i} wrote about nothing" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.sanitise(df))
    assert "Falconridge" not in got[0].text and "[EMAIL]" in got[0].text and "weather" in got[0].text
    assert got[10].text == texts[10]


def test_pii_terms_anywhere_in_the_corpus(spark):
    """Far from the entity, repeated, and in a document without one; a word that a base span touches is no term."""
    far = " ".join(["weather report about nothing"] * 40)
    texts = [f"Write to ann@x.org. {far} Falconridge {far} FALCONRIDGE." for _ in range(6)] + ["Seen again: Falconridge, not Falconridges.", "mail Falconridge@y.org"]
    texts += [f"weather report number {i} about nothing, write again, seen mail" for i in range(60)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.sanitise(df))
    spans = by_id(pii.report(df))
    for i in range(6):
        assert "falconridge" not in got[i].text.lower() and "weather" in got[i].text and spans[i].spans.count("term:") == 2
    assert got[6].text in ("Seen again: , not Falconridges.", "Seen again: [TERM], not Falconridges.") and spans[6].spans.startswith("term:12:23")
    assert got[7].text == "mail [EMAIL]" and all(got[i].text == texts[i] for i in range(8, len(texts)))


def test_licences_as_brute_force(spark):
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "all rights", "reserved", "é", "mit", ",", "\n", "lesser"]
    texts = [None, "", *(" ".join(x) for x in [random.Random(s).choices(bits, k=30) for s in range(80)])]
    got = by_id(license_scan.scan_licenses(frame(spark, texts)))
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        hits = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(hits, default=(None,))[0], max(hits, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_expressions():
    assert license_scan.evaluate("(MIT OR Apache-2.0) AND GPL-2.0-only") == ({"mit", "apache-2.0", "gpl-2.0-only"}, 0.7)
    assert license_scan.evaluate("GPL-2.0 OR MIT AND ISC")[1] == 0.1
    assert license_scan.evaluate("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl-2.0"}, pytest.approx(0.56))
    for broken in ("MIT OR", "(MIT", "MIT)", "AND", "", "MIT */ text"):
        license_scan.evaluate(broken)


def test_html(spark):
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1>'
        "<p>One<br>two <b>three</b><p>It.<aside>See also</aside><script>if(a<b){}</script></article><section class='comments'><p>I like this very much, it is the best page that I have ever seen.</p></section><footer>&copy; x</footer>"
    )
    assert html_extract.extract(page) == "A & B\n\nOne two three\n\nIt."
    plain = "<div><p>" + "A long paragraph of running text, which carries the page. " * 3 + "</p><p>Short.</p><p>" + "Another long paragraph of running text. " * 3 + "</p></div><form>Mail <input></form>"
    assert html_extract.extract(plain).split("\n\n")[1] == "Short."
    for odd in ("", "<", "<p x=\"", "<!-- x", "<script>x", '<div "' * 3000, "<div><p>" * 2000, "</x>" * 2000):
        html_extract.extract(odd)
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 6), (1, "u", page, 5)], "page_id long, url string, html string, n_chars int")
    out = html_extract.extract_text(df)
    assert sorted((r.page_id, r.n_chars, r.text) for r in out.collect())[-1] == (2, 0, "") and out.filter("page_id = 1").count() == 2
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_probes():
    """Hand-labelled pages."""
    long = "A paragraph of running text, which goes on for a while and then ends as a sentence does."
    for page, expected in [
        ('<article><p>One <span style="display:none">no</span>two <span class="advert">buy</span>three.</p></article>', "One two three."),
        (f"<article><p>One.</p><audio src=x><p>Two.</p></article><p>{long}</p>", f"One.\n\nTwo.\n\n{long}"),
        (f'<article><section class="search-engines"><p>{long}</p></section><div class="legal-news"><p>{long}</p></div></article>', f"{long}\n\n{long}"),
        ('<div class="post-header"><h1>Title</h1></div><article><p>One.</p></article>', "Title\n\nOne."),
        (f'<article class="related"><p>{long}</p></article><main><p>Main.</p></main>', "Main."),
        (f'<article><h1>T</h1></article><div class="user-comments"><p>{long}</p><p>{long}</p></div>', "T"),
        (f'<div id="search-box"><p>{long}</p></div><main><h2>Head</h2><ul><li><a href="/">Link</a></li></ul></main>', "Head\n\nLink"),
        (f'<article><p>{long}</p><object data="x">no<p>no</object><p>Two.</p></article><footer><p>{long}</p></footer>', f"{long}\n\nTwo."),
        (f"<div><p>{long}</p><p>short</p><p>{long}</p></div><div><a href='/'>Home</a></div>", f"{long}\n\nshort\n\n{long}"),
    ]:
        assert html_extract.extract(page) == expected, page


def test_the_cut_decides(monkeypatch):
    """On pages of the test tables flow runs, and it changes what the costs alone say."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    calls, flow = [], html_extract.max_flow_side
    monkeypatch.setattr(html_extract, "max_flow_side", lambda *a: calls.append(1) or flow(*a))
    changed = 0
    for html in pages:
        blocks = html_extract.blocks(html or "")
        labels = html_extract.label(blocks)
        changed += any((html_extract.score(b) > 0) != k for b, k in zip(blocks, labels, strict=True))
        costs, links = html_extract.graph(blocks)
        whole = flow(len(costs), costs, links)
        cost = lambda keep: sum(abs(c) for c, k in zip(costs, keep, strict=True) if (c > 0) != k and c) + sum(w for a, b, w in links if keep[a] != keep[b])
        assert cost([*labels, *whole[len(blocks) :]]) == pytest.approx(cost(whole))
    assert len(calls) > len(pages) / 2 and changed > len(pages) / 2


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(keep):
            return sum(s for s, k in zip(scores, keep) if s > 0 and not k) - sum(s for s, k in zip(scores, keep) if s < 0 and k) + sum(w for a, b, w in links if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.max_flow_side(n, scores, links)) == pytest.approx(best)


def test_classifier_learns_and_leaves_folds_alone(spark):
    rng = random.Random(3)
    good, bad = ["the", "river", "runs", "slowly", "and", "wide"], ["win###", "!!", "$$$", "CLICK", "|", "FREE!!"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=40))) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.score_quality(docs, labels))
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert len(held) > 20 and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.9
    assert 0 <= got[1000].score <= 1 and got[1000].score == pytest.approx(got[1001].score)
    assert by_id(quality_classifier.score_quality(docs, labels.limit(0)))[3].score == 0.5
