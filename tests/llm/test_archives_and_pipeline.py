"""Archives make a round trip; the pipeline runs whole; queries agree with their SQL."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest_data import frame_rows
from holdfast.llm import warc_bundles
from holdfast.llm.queries import QUERIES
from holdfast.llm.sql import ORACLES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") > 5, F.concat(F.lit("http://x/\r\n"), "doc_id")).alias("url"),
                       F.col("text").alias("html"), F.lit("x").alias("row"), F.lit("x").alias("digest"), F.lit("x").alias("same"))


def plain(texts, least):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    rows = []
    for i, t in texts:
        payload = (t or "").encode()
        first = max((x for x in groups[t or ""] if x is not None), default=None)
        refers = first if len(payload) >= least and first is not None and first != i else None
        rows.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                     "revisit" if refers is not None else "response", refers))
    return rows


def test_archive_is_read_by_many_tasks(spark, pages):
    archive = warc_bundles.write_archive(pages, frame_bytes=500)
    frames = archive.index.select("bundle", "frame").distinct().count()
    assert warc_bundles.read_archive(archive).rdd.getNumPartitions() == min(frames, 2 * spark.sparkContext.defaultParallelism) > 1


@pytest.mark.parametrize("least", [0, 300])
def test_archive_round_trip(pages, texts, least):
    archive = warc_bundles.write_archive(pages, min_revisit_bytes=least, frame_bytes=2000, bundle_bytes=6000)
    rows = warc_bundles.read_archive(archive)
    assert frame_rows(rows, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == sorted(plain(texts, least), key=repr)
    by_id = {i: t for i, t in texts}
    for r in rows.collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None and r["page_id"] not in (None, 210):
            assert r["payload"].decode() == (by_id[r["page_id"]] or "")
    some = warc_bundles.fetch(archive, rows.where("page_id in (4, 131, 9999)").select("record_id"))
    assert {r["page_id"]: r["payload"].decode() for r in some.collect()} == {i: by_id[i] for i in (4, 131)}


def test_bundles_are_plain_zstandard(pages):
    archive = warc_bundles.write_archive(pages, frame_bytes=2000, bundle_bytes=6000)
    system, path = warc_bundles.filesystem(archive.folder)
    bundles = sorted(Path(path).glob("*.warc.zst"))
    assert len(bundles) > 1
    whole = [zstandard.ZstdDecompressor().stream_reader(b.open("rb"), read_across_frames=True).read() for b in bundles]
    assert sum(w.count(b"WARC/1.1\r\n") for w in whole) == pages.count()
    entry_ = archive.index.where("frame > 0").first()
    with open(f"{path}/{entry_['bundle']}", "rb") as file:
        start, packed, size = warc_bundles.read_seek_table(file)[entry_["frame"]]
        assert start == entry_["frame_offset"]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    fields, _ = warc_bundles.parse_record(data, entry_["offset"])
    assert fields["WARC-Record-ID"] == f"<{entry_['record_id']}>"


def test_no_pages(pages):
    archive = warc_bundles.write_archive(pages.limit(0))
    assert warc_bundles.read_archive(archive).count() == 0


@needs_tables
def test_pipeline_runs_whole(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, FOLDER), name)
        assert kept.columns == docs.columns
        assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
    out = corpus_pipeline.run(spark, FOLDER)
    assert frame_rows(out, ["doc_id"]) == frame_rows(kept, ["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in out.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])


def test_stages_take_odd_documents(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.stored(stage(spark, frame, str(tmp_path)), name)
        assert "ids" in frame.columns


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@needs_tables
def test_every_query_gives_rows(spark):
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
