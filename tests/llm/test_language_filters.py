"""Language filters: held-out accuracy on the given tables, and the odd texts."""

from __future__ import annotations

from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import language_filters as L

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = L.identify(table).join(table, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_odd_texts(docs, texts, no_docs):
    rows = L.identify(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert all(by_id[i] == "und" for i in (200, 201, 202, 203, 205))
    assert {p for i, p in by_id.items() if i not in (200, 201, 202, 203, 205)} <= {"en", "de"}
    assert L.identify(no_docs).count() == 0
    nothing = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_known_languages_keeps_rows_and_columns(docs):
    kept = L.known_languages(docs, 0.0)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({200, 201, 202, 203, 205})


def test_languages_unknown_without_labels(docs):
    """Nothing learned: rows with a letter stay. Labels of any row may teach, those of documents held out elsewhere too."""
    with_letters = docs.where("text rlike '\\\\p{L}'").count()
    assert L.known_languages(docs.withColumn("lang", F.lit(None).cast("string")), 0.3).count() == with_letters
    only = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("und")))
    assert L.known_languages(only, 0.0).count() == with_letters


def test_a_lookup_returns_all_languages_of_an_ngram():
    filters = L.Filters(("a", "b"), np.zeros((1, 1 << 12), dtype=np.uint64))
    for bit, text in enumerate(("mno", "mnp")):
        for at in L.places(L.grams(text), 1 << 12):
            filters.slots[0, at] |= np.uint64(1 << bit)
    none = np.zeros(2)
    assert (L.shares_of("mno", filters, none) == [1, L.shares_of("mno", filters, none)[1]]).all()
    assert 0 < L.shares_of("mno", filters, none)[1] < 1
    assert L.shares_of("12 ...", filters, none) is None and L.shares_of(None, filters, none) is None


def test_long_texts_are_read_in_slices(monkeypatch):
    filters = L.Filters(("a",), np.zeros((1, 1 << 16), dtype=np.uint64))
    for at in L.places(L.grams("abc def " * 10), 1 << 16):
        filters.slots[0, at] |= np.uint64(1)
    whole = L.shares_of("abc def " * 500, filters, np.zeros(1))[0]
    monkeypatch.setattr(L, "SLICE", 64)
    assert whole == 1 and L.shares_of("abc def " * 500, filters, np.zeros(1))[0] > 0.9
