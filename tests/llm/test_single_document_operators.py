"""Operators that look at one document at a time, against brute force, libraries and held-out labels."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skylattice.llm import byte_bpe, fingerprints, html_extract, license_scan, quality, source_mix, token_records, topk_search

ODD = [
    None, "", " ", "  ", "a", "\n", "a b", "a  b", "a \n b", " lead", "trail ", "tab\t tab", "don't we'll  it's", "ünïcödé  straße x", "数字123 и слова", "x" * 5000, "ab" * 3000 + " end",
    "a  b", "\x1c \x1f a", "it 's\r\n\r\n  two", "🙂🙂 ‍", "\x00 null", "…  \t\n\n  z", "<|endoftext|> x", "see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>  b <|endoftext|><|endoftext|> c. ",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def test_bpe_equals_the_library(spark, texts):
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.round_trip(documents(spark, texts), path, pattern).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text), repr(text[:80])
        assert bytes(r.decoded) == text.encode()


def test_records_equal_the_library(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    index = token_records.write_records(documents(spark, texts), str(tmp_path), path, 2)
    rows = sorted(token_records.numbered(token_records.read_files(index), index).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)[:80]
        start += len(ids)
    some = token_records.read_some(index.where("doc_id in (5, 17)")).collect()
    assert {r.doc_id: r.ids for r in some} == {i: [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in (5, 17)}


def test_records_notice_damage(tmp_path):
    record = token_records.frame(token_records.pack(7, np.array([1, 70000], "<u4")))
    import io

    assert token_records.unpack(token_records.read_frame(io.BytesIO(record)))[1].tolist() == [1, 70000]
    for at in (1, 9, 14, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(bad)))


def test_records_of_an_empty_table(spark, tmp_path):
    index = token_records.write_records(documents(spark, []), str(tmp_path), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert index.count() == 0 and token_records.numbered(token_records.read_files(index), index).count() == 0


def test_fingerprints_brute_force(spark, texts):
    chosen = texts[:60]
    got = {r.doc_id: r for r in fingerprints.neighbours(documents(spark, chosen)).collect()}
    assert len(got) == len(chosen)
    for i, text in enumerate(chosen):
        text, following = text or "", chosen[i - 1] or ""
        half = len(text) // 2
        changed = (text[:-half] if half else text) + following[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(text) and r.edited_fingerprint == fingerprints.fingerprint(changed)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(following))


def test_fingerprints_tell_edits_from_strangers(spark, sf):
    rows = fingerprints.op5_fingerprints(spark, sf).where("n_chars > 300").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.35 > 0.1 > np.median([r.near_next for r in rows])


def test_fingerprint_edges(spark):
    assert fingerprints.neighbours(documents(spark, [])).count() == 0
    (only,) = fingerprints.neighbours(documents(spark, ["abc def"])).collect()
    assert only.near_next == 1.0
    a, b = list("kitten sitting"), list("sitting kitten")
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fingerprints.common_length(a, b) == table[-1][-1]


def test_rolling_hash_depends_on_the_window_only():
    data = np.frombuffer(b"some bytes before the same tail", np.uint8)
    other = np.frombuffer(b"quite others, then the same tail", np.uint8)
    assert fingerprints.rolling(data)[-5:].tolist() == fingerprints.rolling(other)[-5:].tolist()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "quality", "predicted", "score").collect()
    assert len(rows) > 300 and all(quality.in_holdout(r.doc_id) for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    wrong = [(r.doc_id, r.quality, round(r.score, 3)) for r in rows if r.quality != r.predicted]
    print("wrong", len(wrong), "of", len(rows), wrong[:10])
    assert np.mean([r.predicted == 1 for r in good]) > 0.97 and np.mean([r.predicted == 0 for r in bad]) > 0.95


def test_quality_edges(spark):
    docs = documents(spark, [None, "", "x " * 2000, "fine words here"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scored(docs, quality.learn(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (3, 1, 0), (None, 1, 1), (1, None, 0), (0, 7, 0)], "doc_id long, quality int, toxic int")
    scores = quality.scored(docs, quality.learn(docs, odd)).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>First  <b>para</b>\n&eacute;<br>more<p>Second<aside>Side words here</aside><p>Third"
        "<div id=ad_1>Buy this now</div><ul><li>one<li>two</ul><section class='comments'><p>A reader says</p></section></article><form>Search</form><footer>&copy; me</footer>"
    )
    texts = [page, None, "", "<p>cut off &am", "no tags at all but quite a few words that stand alone in this page and more of them than any menu line has"]
    rows = sorted(html_extract.extract(spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")).collect())
    assert rows[0].text == "Head & tail\nFirst para é more\nSecond\nThird\none\ntwo"
    assert rows[1].text == "" == rows[2].text and "words that stand" in rows[4].text
    assert all(html_extract.keeps(row[:-1]) == bool(row[-1]) for row in html_extract.LABELLED)


def test_html_on_pages(spark, sf):
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").join(html_extract.op8_html_extract(spark, sf).select("page_id", "text"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        parts = [" ".join(__import__("html").unescape(re.sub(r"</?\w+[^>]*>?", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p), r.page_id


def test_licenses_against_plain_search(spark):
    texts = ["The MIT License, and the mit-license again", "Apache\nLicense", None, "", "general public licensee", "GNU General Public License", "Licensed under the Apache License, Version 2.0.", "é MIT LİCENSE mit ... license"]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert [rows[i].n_base for i in range(8)] == [2, 1, 0, 0, 0, 1, 1, 1]
    assert (rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (1, 5, "mit") and rows[6].labels == "apache" and rows[6].score == 1.0
    assert rows[2].n_words == 0 and rows[2].first_word is None and rows[2].labels == ""
    close = "permission is hereby granted free of any charge to any person obtaining a copy of this software and its associated documentation files the software to deal in the software without restriction"
    (near,) = license_scan.scan_licenses(documents(spark, [close])).collect()
    assert near.labels == "mit" and near.n_base == 0 and 0.75 <= near.score < 1


def test_mix_edges(spark):
    assert source_mix.mix_sources(documents(spark, [])).count() == 0
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7)), None if i % 3 == 0 else f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    rows = source_mix.mix_sources(docs).collect()
    assert len(rows) == 400 and max(r.copies for r in rows) <= 3
    for source in {r.source for r in rows}:
        part = [r for r in rows if r.source == source]
        assert abs(sum(r.size * r.copies for r in part) - part[0].target) <= 6
    assert source_mix.mixed_documents(docs).columns == docs.columns


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (100, [0.1, 0.2]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0]), (1, [1.0, 0.5]), (200, [1e18, 1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, k=3, tile=1, shard=2).collect()
    zero = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 0)
    assert zero == [(1, 200), (2, 1), (3, 1)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fingerprints_count_every_part_of_a_text():
    words = [f"{w}{i % 7}" for i, w in enumerate("lattice river stone amber field quiet north copper".split() * 40)]
    rng = random.Random(3)
    seen = 0
    for k in range(300):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(4, 9)))
        # Lines that return all along a text, so that whatever ends a chunk in one ends one in each.
        half = [f"{line} {rng.choice(words)}" for _ in range(200)]
        other = [f"{rng.choice(words)} {rng.choice(words)} {rng.choice(words)} {k}" for _ in range(200)]
        text, changed = "\n".join(half + half[::-1]), "\n".join(half + other)
        block, fine, coarse = fingerprints.fingerprint(text).split(":")
        seen += len(fine) // 2 > fingerprints.MOST
        assert len(fine) // 2 <= fingerprints.LONGEST
        assert fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(changed)) < 0.9, k
    assert seen


def test_fingerprint_of_a_constant_text_ends():
    for c in (chr(i) for i in range(1, 128)):
        fine = fingerprints.fingerprint(c * 5000).split(":")[1]
        assert 1 <= len(fine) // 2 <= fingerprints.LONGEST


@pytest.mark.parametrize(
    "inside, want",
    [
        ('<p>before it</p><svg class="x"/><p>all the rest</p>', "before it\nall the rest"),
        ("<p>before it</p><svg/><p>between</p><svg><text>drawn</text></svg><p>all the rest</p>", "before it\nbetween\nall the rest"),
        ("<p>so <math><mi>e</mi><mo>=</mo><mn>2</mn></math> holds</p><p>all the rest</p>", "so e=2 holds\nall the rest"),
        ("<p>before it</p><math/><p>all the rest</p>", "before it\nall the rest"),
        ('<p>one <svg class="ad widget"><path d="M0"/><title/><g><text>drawn</text></g></svg>two</p>', "one two"),
        ("<p>before it</p><svg><text>drawn</text><p>all the rest</p><svg></svg>", "before it\nall the rest"),
        ("<p>one <svg><foreignObject><p>drawn</p></foreignObject><text>drawn</text></svg>two</p>", "one two"),
        ("<p>one <noscript><p>no script</p></noscript>two</p>", "one two"),
        ("<p>before it</p><canvas><p>all the rest</p>", "before it\nall the rest"),
        ("<p>before it</p><object data='x'><p>fallback</p></object><template><p>t</p></template><select><option>a<option>b</select><p>all the rest</p>", "before it\nall the rest"),
        ("<p>before it</p><script src='x'/><p>code</p></script><textarea/>typed</textarea><p>all the rest</p>", "before it\nall the rest"),
        ("<p>before it</p><script>var a = '<p>code</p>'", "before it"),
    ],
)
def test_html_dropped_elements_end_where_their_tags_say(inside, want):
    assert html_extract.main_text(f"<article>{inside}</article>") == want


@pytest.mark.parametrize("n_good, n_bad", [(3000, 3000), (2706, 449), (3000, 1500), (1500, 3000), (40, 3), (3, 40), (13, 13), (1, 1)])
def test_quality_pairs_differ(n_good, n_bad):
    good, bad = quality.meetings(n_good, n_bad)
    assert len(good) == max(quality.PAIRS * n_bad, n_good)
    assert len(set(zip(good.tolist(), bad.tolist()))) == min(len(good), n_good * n_bad)
    assert len(set(good.tolist())) == n_good and len(set(bad.tolist())) == n_bad


def slow_fingerprint(text):
    """Context-triggered piecewise hashing written a second time, a byte at a time."""
    data = text.encode()
    if not data:
        return "3::"
    hashes = []
    for i in range(len(data)):
        window = [data[i - j] if i >= j else 0 for j in range(7)]
        shifted = 0
        for j, byte in enumerate(window):
            shifted ^= (byte << 5 * j) % 2**32
        mixed = shifted ^ sum(byte * (8 - j) for j, byte in enumerate(window)) * 0x9E3779B1 % 2**32
        mixed = (mixed ^ mixed >> 15) * 0x85EBCA77 % 2**32
        hashes.append(mixed ^ mixed >> 13)
    ends_for = lambda block: [i for i, h in enumerate(hashes) if h % block == block - 1]
    block = 3
    while block * 64 < len(data):
        block *= 2
    while len(ends_for(block)) < 32 and block > 3:
        block //= 2
    while len(ends_for(block)) >= 64 and (len(ends_for(2 * block)) >= 16 or len(ends_for(block)) >= 4096):
        block *= 2
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = []
    for b in (block, 2 * block):
        chunks, start = [], 0
        for end in [*ends_for(b), len(data) - 1]:
            if end >= start:
                chunks.append(data[start : end + 1])
                start = end + 1
        parts.append("".join(letters[(zlib.crc32(c) & 0xFFF) >> 6] + letters[zlib.crc32(c) & 63] for c in chunks))
    return f"{block}:{parts[0]}:{parts[1]}"


def slow_likeness(a, b):
    """1 less the insert-and-delete distance over the joint length, for signatures of equal block sizes, the better one."""
    if a == b:
        return 1.0
    (m, *left), (n, *right) = a.split(":"), b.split(":")
    best = 0.0
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if int(m) << i != int(n) << j:
                continue
            x2, y2 = [x[k : k + 2] for k in range(0, len(x), 2)], [y[k : k + 2] for k in range(0, len(y), 2)]
            row = list(range(len(y2) + 1))
            for p, u in enumerate(x2, 1):
                last, row[0] = row[0], p
                for q, v in enumerate(y2, 1):
                    last, row[q] = row[q], last if u == v else 1 + min(row[q], row[q - 1])
            if x2 and y2:
                best = max(best, 1 - row[-1] / (len(x2) + len(y2)))
    return best


def test_fingerprints_against_a_second_version(texts):
    rng = random.Random(8)
    some = [t or "" for t in texts[:45]] + ["ab\n" * 700, "".join(rng.choice("abc ") for _ in range(4000))]
    prints = [fingerprints.fingerprint(t) for t in some]
    assert prints == [slow_fingerprint(t) for t in some]
    for text, own in zip(some, prints):
        half = fingerprints.fingerprint(text[: len(text) // 2] + "something else entirely " * (len(text) // 48))
        for other in (half, rng.choice(prints)):
            assert abs(fingerprints.likeness(own, other) - slow_likeness(own, other)) < 1e-12


def test_fingerprint_ranges_follow_the_data(spark, texts, monkeypatch):
    docs = documents(spark, texts[:60])
    want = sorted(tuple(r) for r in fingerprints.neighbours(docs).collect())
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 5000)
    assert sorted(tuple(r) for r in fingerprints.neighbours(docs).collect()) == want


def test_quality_loss_and_gradient():
    rng = np.random.default_rng(4)
    d = rng.normal(0.4, 1, (200, 5))
    w = quality.fit(d)
    loss = lambda v: float(np.mean(np.log1p(np.exp(-d @ v))) + quality.RIDGE / 2 * v @ v)
    slopes = [(loss(w + e) - loss(w - e)) / 2e-5 for e in np.eye(5) * 1e-5]
    assert np.abs(slopes).max() < 1e-6
    # Plain gradient descent, pair by pair, ends at the same place.
    v = np.zeros(5)
    for _ in range(4000):
        g = np.zeros(5)
        for row in d[:, None, :]:
            g -= row[0] / (1 + math.exp(float(row[0] @ v)))
        v -= 0.5 * (g / len(d) + quality.RIDGE * v) if np.abs(g).max() else 0
        if np.abs(g / len(d) + quality.RIDGE * v).max() < 1e-7:
            break
    assert np.abs(v - w).max() < 1e-4


def test_quality_threshold_is_a_quantile():
    values, mass = np.array([4.0, 1.0, 3.0, 2.0]), np.full(4, 0.25)
    assert quality.quantile(values, mass, 0.5) == 2.5 and quality.quantile(values, mass, 0.25) == 1.5
    assert quality.quantile(values, mass, 0.0) == 1.0 and quality.quantile(values, mass, 1.0) == 4.0


def test_top_k_spreads_candidates_of_one_tile(spark):
    import pyspark.sql.functions as f

    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(4)]) for i in range(200)] + [(5, [1.0] * 4)] * 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, f.col("vec_id") % 100 == 0, k=4, shard=32)
    scaled = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q in (0, 100):
        own = next(v for i, v in scaled if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in scaled if i != q)[:4]
        assert [(-r.score, r.vec_id) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
    seen = spark.createDataFrame([(i,) for i in range(300)], "row long").select(f.pmod(f.xxhash64("row"), f.lit(10)).alias("shard"))
    assert seen.distinct().count() == 10


def test_one_long_piece_is_merged_quickly():
    import time

    path, pattern = byte_bpe.public_ranks()
    own = byte_bpe.encoder(path, pattern)
    rng = random.Random(6)
    for n in (5, 64, 700, 3000):
        piece = "".join(rng.choice("abcdeéß") for _ in range(n)).encode()
        assert own.bpe.merge_long(piece) == own.bpe.merge([piece], 1 << (len(piece) - 1).bit_length())[0]
    start = time.time()
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    (ids,) = own.encode([long])
    assert own.bpe.decode(np.frombuffer(ids, "<i4").tolist()) == long.encode() and time.time() - start < 20


def test_bpe_with_another_pattern_encodes_texts_whole():
    import tiktoken

    path, _ = byte_bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"[a-z ]+|[^a-z ]"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("several words in one match", "a b. c d", ""):
        assert np.frombuffer(byte_bpe.Encoder(path, pattern).encode([text])[0], "<i4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize(
    "page",
    [
        "<script '" * 500_000, "<span>" * 400_000 + "</b>" * 400_000, "<p>" + "<span>" * 400_000 + "<hr>" * 400_000, "<a " + "a" * 5_000_000 + ">x</a>", "<" * 5_000_000,
        "<a '" * 400_000 + '<a "' * 400_000, "<!--" * 1_000_000, "<svg><foreignObject>" + "<span>" * 300_000 + "<hr>" * 300_000 + "</svg>",
    ],
    ids=range(8),
)
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 10


def test_single_document_operators_on_odd_tables(spark):
    long = "mit license " * 30_000
    docs = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, None, 8), (2, "", 9)], "doc_id long, text string, key int")
    rows = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in license_scan.scan_licenses(docs).collect())
    assert rows == [(0, 0, 0, ""), (1, 60_000, 30_000, "mit"), (1, 60_000, 30_000, "mit"), (2, 0, 0, "")]
    none = docs.limit(0)
    assert license_scan.scan_licenses(none).count() == 0 and quality.scored(none, quality.learn(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    path, pattern = byte_bpe.public_ranks()
    assert byte_bpe.round_trip(none, path, pattern).count() == 0
    kept = byte_bpe.round_trip(docs.withColumnsRenamed({"key": "whole_text"}), path, pattern).collect()
    assert sorted((r.doc_id or 0, r.whole_text, bytes(r.decoded).decode()) for r in kept) == [(0, 8, ""), (1, 7, long), (1, 7, long), (2, 9, "")]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    same = sorted((r.doc_id or 0, r.near_next) for r in fingerprints.neighbours(docs).collect())
    assert same[1][1] == 1.0 or same[2][1] == 1.0


def test_mix_with_equal_keys_and_a_weight_column(spark):
    docs = spark.createDataFrame([(5, "a b c", "s", 0.5, 1)] * 6 + [(i, "a b", "s", None, 2) for i in range(20)], "doc_id long, text string, source string, w double, size int")
    rows = source_mix.mix_sources(docs, weight="w").collect()
    assert len(rows) == 26 and len({r.copies for r in rows if r.doc_id == 5}) == 1
    assert source_mix.mixed_documents(docs).select("size").distinct().count() <= 2


def test_license_scan_takes_time_in_proportion_to_a_text(spark):
    import time

    words = 1_000_000
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 977}" for i in range(words)) + " released under the mit license")], "doc_id long, text string")
    license_scan.scan_licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string")).collect()
    start = time.time()
    (row,) = license_scan.scan_licenses(docs).collect()
    assert (row.n_words, row.first_word, row.labels, row.score) == (words + 5, words + 3, "mit", 1.0) and time.time() - start < 20


def test_units_at_line_ends_and_other_white_space():
    """Words are remembered by themselves only where the library cuts there: hostile runs of white space, punctuation and added tokens."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_records.library_encoder(path)
    rng = random.Random(7)
    bits = ["a", "the", "Word", "'s", "don't", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\x85", " ", "　", "\x1c", ".", ",", "%%%", "12", "é", "ñandú", "<|endoftext|>", "​", "😀", "_", "-"]
    for _ in range(150):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(25)]
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_records_of_a_long_text_and_repeated_null_ids(spark, tmp_path):
    import public_tokenizers

    long = "token records\n" * 200_000
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (None, "a"), (3, long), (-1, None)], "doc_id long, text string")
    index = token_records.write_records(docs, f"file://{tmp_path}/r", public_tokenizers.path("byte_bpe_50k.json"), 2)
    rows = token_records.numbered(token_records.read_files(index), index).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, None, -1, 3] and [r.n_tokens for r in rows[:4]] == [2, 2, 2, 1]
    assert rows[0].ids_crc32 == rows[1].ids_crc32 != rows[2].ids_crc32 and rows[4].n_tokens > 400_000


LAYOUTS = {
    "section ids": ('<article><h1>Head</h1><p>Words of the text stand here.</p><section id="social-history"><h2>Kept</h2><p>Kept too</p></section></article>', "Head\nWords of the text stand here.\nKept\nKept too"),
    "heading ids": ('<article><h2 id="in-popular-culture">Popular</h2><p id="advertising">Kept</p><h2 id="trending">Trending</h2><p class="warning">Mind it</p></article>', "Popular\nKept\nTrending\nMind it"),
    "compound classes": ('<article><p>One two three four</p><div class="share-price">Kept</div><section class="comment-free">Kept</section><div class="share-bar">Out</div><div class="ad-slot">Out</div></article>', "One two three four\nKept\nKept"),
    "sections named like furniture": ('<article><p>One two three four</p><section id="popular"><h2>Popular</h2><p>Kept</p></section><div id="comments"><p>Out</p></div></article>', "One two three four\nPopular\nKept"),
    "no article": ("<body><h1>A heading</h1>" + "<p>ten short words stand in each of these few paragraphs</p>" * 3 + "</body>", "A heading" + "\nten short words stand in each of these few paragraphs" * 3),
    "list without article": ("<body><ul>" + "".join(f"<li>item number {i}</li>" for i in range(5)) + "</ul></body>", "\n".join(f"item number {i}" for i in range(5))),
    "menus without article": ("<body><ul>" + "<li><a href=x>One link</a></li>" * 5 + "</ul><h1>Head</h1><p>Short text.</p><p>See <a href=y>this</a> page too.</p><div><a href=z>About</a></div><div><a href=z>Imprint</a></div></body>", "Head\nShort text.\nSee this page too."),
    "page in a form and a menu's box": ('<body><form id="all"><div class="nav-container"><article><p>The whole article</p><button>Out</button></article></div></form></body>', "The whole article"),
    "comments larger than the article": ('<body><article><p>Small article</p></article><section class="comments"><article>' + "out " * 200 + "</article></section></body>", "Small article"),
    "furniture": ('<body><header>Out</header><nav>Out</nav><div class="cookieBanner">Out</div><main><p>Kept words of text</p><p class="ad">Out</p><aside>Out</aside><form>Out</form></main><footer>Out</footer></body>', "Kept words of text"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_html_layouts(name):
    page, want = LAYOUTS[name]
    assert html_extract.main_text(page) == want


def test_mix_closes_in_on_the_cut_whatever_the_weights(spark, monkeypatch):
    """Weights of 0.01, null and 1, and few rows put in order: against a plain sort of the keys."""
    import hashlib
    import math

    monkeypatch.setattr(source_mix, "BINS", 16)
    monkeypatch.setattr(source_mix, "LEFT", 8)
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 4}" if i % 5 else None, [None, 0.01, 1.0, 0.3][i % 4]) for i in range(1200)] + [(7, "a b c", "s3", 0.5)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = source_mix.mix_sources(docs, weight="w").collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for part in by_source.values():
        key = lambda r: -math.log((int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) + 1) / 2**52) / max(0.01, 0.01 if r.w is None else r.w)
        epochs = min(r.copies for r in part)
        budget = part[0].target - math.floor(part[0].target / part[0].source_size) * part[0].source_size
        sums, total = {}, 0
        for r in sorted(part, key=key):
            total += r.size
            sums[key(r)] = total
        best = min((abs(t - budget), k) for k, t in sums.items())
        want = {k for k in sums if k <= best[1]} if best[0] < budget else set()
        assert {key(r) for r in part if r.copies > epochs} in (want, set() if len(want) == len(sums) else want)
    plan = source_mix.measured(docs.select("doc_id", "text", "source", "w"), "doc_id", "text", "source", "w").select("mix_row.*")
    sums = plan.groupBy("mix_source").agg(F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi"), (F.sum("size") / 2).alias("budget"))
    at = sums.select(F.col("mix_source").alias("at_source"), "budget", "lo", "hi", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"))
    for _ in range(6):
        at = source_mix.close_in(plan, at)
    assert all(r.n <= 8 or r.lo == r.hi for r in at.collect())


def test_half_equal_texts_are_half_alike(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 1500 and 20000").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(set(t.split())) > 0.3 * len(t.split())]
    near = [fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a[: len(a) - len(a) // 2] + (b * 9)[: len(a) // 2])) for a, b in zip(texts, texts[1:])]
    assert len(near) > 40 and sum(0.25 <= x <= 0.75 for x in near) > 0.9 * len(near)


def test_fingerprints_of_rows_with_one_id(spark, monkeypatch):
    """All rows have one id or none: they are dealt to many ranges, in the order of their texts, and each meets the one before it."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 300)
    texts = [f"{i:03d} " + f"word{i} " * 20 for i in range(60)]
    docs = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = fingerprints.neighbours(docs).collect()
    order = sorted(((-1 if i % 2 else 5), t) for i, t in enumerate(texts))
    want = {(d if d == 5 else None, hashlib.sha256(fingerprints.edited(t, order[k - 1][1]).encode()).hexdigest()) for k, (d, t) in enumerate(order)}
    assert {(r.doc_id, r.edited_sha256) for r in rows} == want and len(rows) == 60
    ranged = fingerprints.in_ranges(docs, 12).groupBy("range").count().collect()
    assert len(ranged) > 6 and max(r["count"] for r in ranged) < 25
