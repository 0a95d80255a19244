"""The pipeline's encoder decodes what it has encoded; an empty text may come first."""

import pytest

from skylattice.llm import byte_bpe, fingerprints


def test_the_pipeline_decodes_its_ids(spark, monkeypatch):
    """F8."""
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in byte_bpe.encode_documents(docs).collect()] == [1, 2, 3]
    path, _ = byte_bpe.public_ranks()
    monkeypatch.setattr(byte_bpe, "public_ranks", lambda: (path, "[a-z]+"))
    with pytest.raises(Exception, match="do not decode"):
        byte_bpe.encode_documents(docs).collect()


def test_an_empty_text_first_in_its_range(spark):
    rows = spark.createDataFrame([(0, 0, 1, ""), (0, 0, 2, "a b c d e f g h"), (0, 0, 3, "")], "range long, ghost int, doc_id long, text string")
    prints = [r["fingerprint"] for r in fingerprints.compared(rows.coalesce(1)).collect()]
    assert prints[0] == prints[2] == fingerprints.fingerprint("")
