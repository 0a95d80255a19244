"""Every labelled row teaches the quality classifier, however many there are."""

import numpy as np
import pytest
from test_quality_second_version import second_version

from skylattice.llm import quality


def test_more_labels_than_the_old_sample_against_the_second_version(spark):
    words = ["fine", "Text", "of", "some", "words", "12", "here,", "and", "MORE!", "$$$"]
    made = np.random.default_rng(1)
    docs = [(i, " ".join(made.choice(words[: 8 if i >= 50 else 10], 5 + i % 30))) for i in range(4600)]
    labels = {i: int(i >= 50) for i, _ in docs}
    assert sum(y == 1 and not quality.in_holdout(i) for i, y in labels.items()) > 3000
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    ranking = quality.learn(table, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    want = second_version(docs, labels)
    for r in quality.scored(table, ranking).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


@pytest.mark.parametrize("share", [0.0, 0.004, 0.3, 0.5, 0.97, 1.0])
def test_threshold_closed_in_on_is_the_quantile(spark, monkeypatch, share):
    monkeypatch.setattr(quality, "LEFT", 3)
    monkeypatch.setattr(quality, "BINS", 4)
    made = np.random.default_rng(2)
    s = np.concatenate([made.normal(size=200), np.full(40, 0.25), [1e6, -1e6]])
    y = (made.random(len(s)) < 0.7).astype(int)
    of_bad, of_good = share / (y == 0).sum(), (1 - share) / (y == 1).sum()
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    order = np.lexsort((np.where(y == 0, of_bad, of_good), s))
    want = quality.quantile(s[order], np.where(y == 0, of_bad, of_good)[order], share)
    assert quality.spread_quantile(rows, of_bad, of_good, share) == pytest.approx(want, abs=1e-12)
