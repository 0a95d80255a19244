"""Operators that compare documents, against brute force over small tables."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import line_dedup, ngram_join
from skylattice.operators import components

SCHEMA = "doc_id long, text string"


def brute_lines(docs, least):
    """Deletes every line inside a run of at least `least` words that stands earlier, id and place deciding."""
    seqs = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        seqs[d] = (lines, at, [lines[i] for i in at], [len(lines[i].split()) for i in at])
    seen, gone = set(), {d: set() for d in seqs}
    for d in sorted(seqs):
        lines, at, seq, words = seqs[d]
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                if sum(words[i:j]) >= least:
                    run = tuple(seq[i:j])
                    if run in seen:
                        gone[d].update(range(i, j))
                    seen.add(run)
    out = {}
    for d, (lines, at, _, _) in seqs.items():
        cut = {at[i] for i in gone[d]}
        for a, b in zip(at, at[1:]):
            if a in cut and b in cut:
                cut.update(range(a, b))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in cut), len(cut))
    return out


def test_line_dedup_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) for _ in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "\nnew"), (102, ""), (103, "a\n" * 40), (104, "one two three\n" * 9)]
    for least in (1, 6, 20):
        got = {r.doc_id: (r.text, r.n_cut) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA), least=least).collect()}
        assert got == brute_lines(docs, least), least


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(str(i) for i in range(60))
    rows = [(2, long), (2, long), (None, None), (7, None), (None, long), (9, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    # The null id comes first and keeps its text; both equal rows lose theirs.
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got) == sorted([(False, 0, ""), (False, 0, long), (True, 2, ""), (True, 2, ""), (True, 7, ""), (True, 9, "")])
    kept = line_dedup.deduped_documents(spark.createDataFrame([(1, long, 5), (2, long, 5), (3, "", 0), (4, long + "\nmore", 9)], SCHEMA + ", n_chars long")).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(1, long, 5), (3, "", 0), (4, "more", 4)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_components(docs):
    sets = {}
    for d, text in docs:
        w = words_of(text)
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(rng, n_groups, sizes, length):
    docs, common = [], [f"c{i}" for i in range(40)]
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(*length))]
        for _ in range(rng.choice(sizes)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            if rng.random() < 0.3:
                words[:0] = common
            docs.append((len(docs), " ".join(words)))
    return docs


def test_ngram_join_brute_force(spark):
    rng = random.Random(11)
    docs = near_copies(rng, 30, [1, 2, 5, 9], (8, 300)) + []
    docs += [(5000 + i, t) for i, t in enumerate([None, "", "one", "ONE", "one two three", "one two\tthree", "\x1f", "a b c d", "A b c D", "e " * 50, "e " * 60, docs[0][1]])]
    got = ngram_join.components_of(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(12)
    docs = near_copies(rng, 4, [60], (30, 60)) + []
    docs += [(1000 + d, t) for d, t in near_copies(rng, 3, [50], (100, 130))]
    rng.shuffle(docs)
    got = ngram_join.components_of(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_ngram_join_edges(spark):
    assert ngram_join.components_of(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (4, "other words stand here now"), (None, None)]
    got = sorted((r.doc_id is None, r.n_shingles, r.component_id or -1) for r in ngram_join.components_of(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 2, 4), (False, 2, 4), (False, 2, 4), (True, 0, -1), (True, 2, 4)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1003), (1003, 1001)]
    got = {r.u: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1003: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30), st.integers(1, 20))
def test_stretches(words, least):
    ahead, back = line_dedup.stretches(words, least) if words else ([], [])
    for i in range(len(words)):
        assert ahead[i] == next((k for k in range(1, len(words) - i + 1) if sum(words[i : i + k]) >= least), 0)
        assert back[i] == next((k for k in range(1, i + 2) if sum(words[i - k + 1 : i + 1]) >= least), 0)
