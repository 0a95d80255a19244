"""Texts of some megabytes through the operators over lines, sets and sizes."""

from skylattice.llm import line_dedup, ngram_join, source_mix


def test_long_texts(spark):
    run = "\n".join(f"line {i} of a passage that repeats" for i in range(20))
    body = "\n".join(f"own words {i * 7919 % 100_003} and {i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, f"{run}\n{body}", "a"), (2, f"{body}\nlast line here", "b"), (3, f"{run}\nshort rest", "a"), (4, "x", None)], "doc_id long, text string, source string")
    cut = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert cut[1].n_cut == 0 and cut[2].n_cut == 120_000 and cut[3].n_cut == 20
    parts = {r.doc_id: r.component_id for r in ngram_join.components_of(docs).collect()}
    assert parts == {1: 1, 2: 1, 3: 3, 4: 4}
    sizes = {r.doc_id: r.size for r in source_mix.mix_sources(docs).collect()}
    assert sizes == {1: 20 * 7 + 5 * 120_000, 2: 5 * 120_000 + 3, 3: 20 * 7 + 2, 4: 1}
