"""The pipeline's stages, each against a brute-force version of its decisions."""

import random

import corpus_pipeline
import pytest
from test_corpus_operators import brute_components, brute_lines, near_copies, words_of

from pyspark.sql import functions as F

from skylattice.llm import byte_bpe, common, ngram_join, quality


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ranking = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import numpy as np

    want = {r.doc_id: r.text for r in docs.collect() if ranking.score(np.array([quality.features(r.text)]))[0] >= quality.CUT}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality"](spark, docs, sf)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want and len(want) > 150

    lines = brute_lines(list(want.items()), 50)
    want = {d: t for d, (t, cut) in lines.items() if not cut or t.strip()}
    docs = stages["line_dedup"](spark, docs, sf)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want

    parts = brute_components(list(want.items()))
    want = {d: t for d, t in want.items() if parts[d][1] == d}
    docs = stages["ngram_join"](spark, docs, sf)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want

    mixed = stages["source_mix"](spark, docs, sf)
    assert mixed.columns == columns
    rows = mixed.collect()
    assert {r.doc_id for r in rows} <= want.keys() and all(r.text == want[r.doc_id] for r in rows)
    total = lambda texts: sum(len(t.split()) for t in texts)
    assert abs(total(r.text for r in rows) - total(want.values())) < 0.1 * total(want.values())

    last = stages["byte_bpe"](spark, mixed, sf).collect()
    path, pattern = byte_bpe.public_ranks()
    assert len(last) == len(rows)
    encode = byte_bpe.Encoder(path, pattern)
    assert all(byte_bpe.np.frombuffer(encode.encode([want[r.doc_id]])[0], "<i4").tolist() == r.ids for r in last[:40])


def brute_links(docs, words, link):
    """The least id of each document's component, by shingles of so many words and links from so many percent on."""
    sets = {}
    for d, text in docs:
        w = words_of(text)
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= link * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {d: new if x == old else x for d, x in label.items()}
    return label


def test_near_duplicate_stage_takes_five_words_and_80(spark):
    rng = random.Random(21)
    docs = near_copies(rng, 30, [1, 2, 5, 9], (5, 300))
    docs += [(2000 + d, t) for d, t in near_copies(rng, 2, [60], (30, 60))]
    # One word fewer of nine leaves 4 of 5 shingles; 100 shingles of which the last 11 or 12 differ share 89 of 111 and 88 of 112.
    docs += [(5000, "a b c d e f g h i"), (5001, "a b c d e f g h"), (5002, "a b c d"), (5003, "a b c"), (5004, ""), (5005, None)]
    base = [f"v{i}" for i in range(104)]
    docs += [(6000, " ".join(base)), (6001, " ".join(base[:-11] + ["z"] * 11)), (6002, " ".join(base[:-12] + [f"y{i}" for i in range(12)]))]
    want = brute_links(docs, 5, 80)
    strict = brute_links(docs, 4, 85)
    assert sum(d == x for d, x in want.items()) < sum(d == x for d, x in strict.items())
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    got = stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, x in want.items() if d == x)


@pytest.mark.parametrize("words, link", [(5, 80), (2, 90)])
def test_links_by_words_and_percent(spark, words, link, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(words)
    docs = near_copies(rng, 3, [50], (20, 130)) + [(1000 + d, t) for d, t in near_copies(rng, 12, [1, 6], (5, 60))]
    got = ngram_join.components_of(spark.createDataFrame(docs, "doc_id long, text string"), words=words, link=link).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_links(docs, words, link)


def test_links_that_the_prefixes_do_not_hold_for_are_refused(spark):
    with pytest.raises(ValueError):
        ngram_join.components_of(spark.createDataFrame([], "doc_id long, text string"), link=50)


def test_near_duplicate_stage_with_repeated_and_null_ids(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    # Rows that repeat, a copy without an id, a component of null ids only, one id in two components, texts without words.
    rows = [(4, a), (4, a), (9, a), (None, a), (None, b), (None, b), (4, c), (7, c), (7, c), (1, ""), (1, ""), (None, None)]
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert got.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(4, a), (0, b), (4, c), (1, ""), (1, ""), (0, "")])


CLASHES = {
    "quality": ["score", "predicted", "held_out", "label"],
    "line_dedup": ["doc", "mark", "cuts", "_lines", "n_lines", "n_cut", "line_dedup_doc", "line_dedup_mark", "line_dedup_cuts", "line_dedup_lines", "line_dedup_done"],
    "ngram_join": ["uid", "row", "id", "component", "stays", "skylattice_row"],
    "source_mix": ["bin", "mix_key", "mix_source", "cut", "epochs", "plan_source", "size", "target", "copies", "mix_row", "mix_words", "mix_taken", "mix_copy", "cut_bin", "_copy", "mix_0"],
    "byte_bpe": ["_text_", "whole_text"],
}


@pytest.mark.parametrize("name", CLASHES)
def test_columns_of_the_user_survive(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text", "source", "n_chars").withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in CLASHES[name]})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    want = [c for c in docs.columns if name != "byte_bpe" or c != "text"]
    assert [c for c in out.columns if c != "ids" or name != "byte_bpe"] == want
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES[name])


def test_pipeline_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_a_sieve_lets_all_its_keys_pass(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    passed = {r.id for r in spark.range(3000).where(common.sieve(keys)("id")).collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1010
    assert spark.range(5).where(common.sieve(keys.limit(0))("id")).count() == 0
