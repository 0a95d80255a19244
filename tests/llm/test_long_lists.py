"""Long lists of the n-gram join: what is compared, and that no link is lost."""

import random

import pytest

from skylattice.llm import ngram_join
from skylattice.llm.common import Scratch

from test_corpus_operators import SCHEMA, brute_components, near_copies


def test_a_long_list_of_small_sets_is_one_tile(spark, monkeypatch):
    rng, rows, table = random.Random(3), {}, Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    texts = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(30))) for i in range(299)]
    texts.append((299, texts[0][1] + " more"))
    keep = Scratch(spark)
    long = spark.createDataFrame([(u, 27, u, 5, 1, 300, 27 * 300) for u, _ in texts], "u long, n int, label long, sig long, one int, k long, mass long")
    links = ngram_join.tile_links(keep, spark.createDataFrame([(u, t.encode()) for u, t in texts], "uid long, text binary"), long, 4, 85)
    assert {tuple(sorted(r)) for r in links.collect()} == {(0, 299)}
    assert rows["tiles"] == 1


@pytest.mark.parametrize("tile, sets", [(8, 4), (16, 64)])
def test_no_link_is_lost_where_vertices_leave_their_longest_lists(spark, monkeypatch, tile, sets):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "TILE_SETS", sets)
    monkeypatch.setattr(ngram_join, "PIVOTS", ((0,), ()))
    rng = random.Random(tile)
    docs = near_copies(rng, 6, [30], (25, 60)) + [(1000 + d, t) for d, t in near_copies(rng, 3, [40], (100, 130))]
    common = " ".join(f"c{i}" for i in range(40))
    docs += [(3000 + i, " ".join(common.split()[: 30 + i % 10]) + f" t{i // 3} u{i // 3} v{i // 2}") for i in range(60)]
    got = ngram_join.components_of(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
