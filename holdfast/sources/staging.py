"""Staging: extracts become all-text rows that know where they came from."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from holdfast.scale import settle
from holdfast.spec import EXTRA_CELLS, LINEAGE_COLUMNS, ROW_ORDER, Project, Source

# Rows of one file are numbered below this, so that the ranks of 134 million files and row numbers fit one long.
ROWS_PER_FILE = 1 << 36
# Files up to this size are hashed by Spark's own reader, on any file system it knows.
WHOLE_FILE_BYTES = 256 << 20
# A listing and a scan spell local paths with a different number of slashes.
_LOCAL_FILE = re.compile("^file:/+")


class StagingError(RuntimeError):
    """An extract cannot be staged as declared."""


@dataclass(frozen=True)
class Staged:
    """All-text rows of one source, and the columns its file really had."""

    source: Source
    rows: DataFrame
    present: tuple[str, ...]


def bind_files(project: Project, paths: Iterable[str]) -> dict[str, list[str]]:
    """Assign each file to the one source whose pattern fits its name."""
    bound: dict[str, list[str]] = {}
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        fits = [s.source_id for s in project.sources
                if any(fnmatch.fnmatchcase(name.lower(), p.lower()) for p in s.file_patterns)]
        if len(fits) != 1:
            raise StagingError(f"{name!r} fits {fits or 'no source'}; it must fit exactly one")
        bound.setdefault(fits[0], []).append(path)
    return bound


def stage_frame(frame: DataFrame, source: Source, *, run_id: str, report_id: str,
                row_number: Column, source_file: Column, row_order: Column | None = None,
                file_hash: Column | None = None, extracted_at: str | None = None,
                schema_version: str = "1", extra_cells: Column | None = None) -> Staged:
    """Keep declared columns as text, NULL for absent ones, and stamp every row's origin.

    Columns are found by name. Undeclared columns are never read. ``extra_cells`` is the whole line of a row with more
    cells than the header, NULL for others; such rows are rejected when they are typed.
    """
    stamp = extracted_at or datetime.now(timezone.utc).isoformat()
    text = [(F.col(f"`{name}`").cast("string") if name in frame.columns else F.lit(None).cast("string")).alias(name)
            for name in source.names]
    lineage = {
        "_run_id": F.lit(run_id),
        "_report_id": F.lit(report_id),
        "_source_id": F.lit(source.source_id),
        "_source_file": source_file,
        "_source_file_hash": F.lit(None).cast("string") if file_hash is None else file_hash,
        "_source_sheet": F.lit(source.sheet),
        "_source_row_number": row_number.cast("long"),
        "_extracted_at": F.lit(stamp),
        "_schema_version": F.lit(schema_version),
    }
    order = row_number if row_order is None else row_order
    rows = frame.select(*text, *[lineage[n].alias(n) for n in LINEAGE_COLUMNS], order.cast("long").alias(ROW_ORDER),
                        *([] if extra_cells is None else [extra_cells.alias(EXTRA_CELLS)]))
    return Staged(source, rows, tuple(c for c in frame.columns if not c.startswith("_file_")))


def stage_files(spark: SparkSession, source: Source, paths: Sequence[str], *, run_id: str, report_id: str,
                file_format: str = "csv", hash_files: bool = True, multiline: bool = False, **stamp: str) -> Staged:
    """Stage every file of one source. All files must have the same header.

    ``multiline`` allows line breaks inside quoted CSV values; such files cannot be split. A CSV row with fewer cells than
    the header has NULL in the others; one with more keeps its line.
    """
    if file_format == "csv":
        scan = _csv_rows(spark, paths, multiline)
    elif file_format == "parquet":
        # Parquet knows each row's position; it has no header line.
        scan = spark.read.parquet(*paths).select(
            "*", F.col("_metadata.file_path").alias("_file_path"),
            (F.col("_metadata.row_index") + 1).alias("_file_row"))
    else:
        raise StagingError(f"no reader for {file_format!r}")
    files = _file_table(spark, paths, [_LOCAL_FILE.sub("file:///", path) for path in scan.inputFiles()], hash_files)
    scan = scan.withColumn("_file_path", F.regexp_replace("_file_path", _LOCAL_FILE.pattern, "file:///"))
    # One row per input file, which the driver has listed to plan the scan.
    rows = scan.join(F.broadcast(files), "_file_path", "left")
    rank = F.coalesce("_file_rank", F.raise_error(F.concat(F.lit("file was not listed: "), "_file_path")).cast("long"))
    return stage_frame(
        rows, source, run_id=run_id, report_id=report_id,
        row_number=F.col("_file_row"), source_file=F.col("_file_path"), file_hash=F.col("_file_sha256"),
        row_order=rank * ROWS_PER_FILE + F.col("_file_row"),
        extra_cells=F.col("_file_overlong") if file_format == "csv" else None, **stamp)


def _csv_rows(spark: SparkSession, paths: Sequence[str], multiline: bool = False) -> DataFrame:
    """CSV rows as text with their line number: the header is line 1, data starts at 2.

    A task reads each file block from front to back, so a row's place in its block is the
    distance from the block's first generated id, and the blocks before it in the same
    file give the rest. Nothing is sorted and rows are not shuffled.
    """
    def reader() -> DataFrameReader:
        # A quote inside a quoted value is written twice.
        return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)

    header = reader().csv(list(paths)).schema
    # Spark keeps the line of a row whose cells are not as many as the header's.
    with_line = StructType([*header.fields, StructField("_file_line", StringType())])
    # enforceSchema=False compares every file's header with the first one's; without
    # pruning the comparison covers all columns and not just the declared ones.
    scan = (reader().option("enforceSchema", False).option("columnPruning", False)
            .option("columnNameOfCorruptRecord", "_file_line").schema(with_line)
            .csv(list(paths))
            .withColumn("_file_overlong", F.when(_cells(F.col("_file_line")) > len(header.fields), F.col("_file_line")))
            .drop("_file_line")
            .select("*", F.col("_metadata.file_path").alias("_file_path"),
                    F.col("_metadata.file_block_start").alias("_file_block"),
                    F.monotonically_increasing_id().alias("_file_scan_id")))
    earlier = Window.partitionBy("_file_path").orderBy("_file_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (scan.groupBy("_file_path", "_file_block")
              .agg(F.min("_file_scan_id").alias("_file_first"), F.count("*").alias("_file_rows"))
              .withColumn("_file_before", F.coalesce(F.sum("_file_rows").over(earlier), F.lit(0)))
              .select("_file_path", "_file_block", "_file_first", "_file_before"))
    # One row per file block, that is per unit of work of the scan itself.
    placed = scan.join(F.broadcast(blocks), ["_file_path", "_file_block"])
    number = F.col("_file_scan_id") - F.col("_file_first") + F.col("_file_before") + 2
    return placed.withColumn("_file_row", number).drop("_file_block", "_file_scan_id", "_file_first", "_file_before")


def _cells(line: Column) -> Column:
    """Number of cells of a CSV line: commas outside quotes, and one."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _file_table(spark: SparkSession, paths: Sequence[str], files: Sequence[str], hash_files: bool) -> DataFrame:
    """Path, rank in path order and SHA-256 of each input file.

    Files of ordinary size are read and hashed by Spark, wherever it can read; larger ones are streamed by one task each.
    """
    ranked = [(path, rank) for rank, path in enumerate(sorted(files))]
    listed = spark.createDataFrame(ranked, "_file_path string, _file_rank long")
    if not hash_files:
        return listed.withColumn("_file_sha256", F.lit(None).cast("string"))
    whole = (spark.read.format("binaryFile").load(list(paths)).where(F.col("length") <= WHOLE_FILE_BYTES)
             .select(F.regexp_replace("_metadata.file_path", _LOCAL_FILE.pattern, "file:///").alias("_file_path"),
                     F.sha2("content", 256).alias("_file_sha256")))
    small = settle(listed.join(whole, "_file_path"))
    large = listed.join(small, "_file_path", "left_anti")
    return small.unionByName(_streamed(spark, large, len(ranked)))


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``source_file, file_sha256`` of input files, without reading a row of them."""
    files = spark.read.text(list(paths)).inputFiles()
    return _file_table(spark, paths, [_LOCAL_FILE.sub("file:///", path) for path in files], True).select(
        F.col("_file_path").alias("source_file"), F.col("_file_sha256").alias("file_sha256"))


def _streamed(spark: SparkSession, listed: DataFrame, files: int) -> DataFrame:
    """SHA-256 of files too large to be held, each streamed in blocks by one task."""
    def hashed(batches: Iterator) -> Iterator:
        # A nested function travels by value, so executors need not have this package.
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch.column("_file_path").to_pylist():
                # The names that Hadoop and Arrow give to the same stores.
                system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
                digest = hashlib.sha256()
                with system.open_input_stream(path) as stream:
                    while block := stream.read(8 * 1024 * 1024):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())],
                                             names=[*batch.schema.names, "_file_sha256"])

    slices = max(1, min(files, spark.sparkContext.defaultParallelism))
    return listed.repartition(slices, "_file_path").mapInArrow(
        hashed, "_file_path string, _file_rank long, _file_sha256 string")


def staging_audit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per file: first and last row, row count and a content hash that ignores row order.

    The content hash is the md5 of the row count and the sum of 60 bits of every row's
    md5, so it needs no sort and merges partial sums before the shuffle.
    """
    row_digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.trim(c), F.lit("\x00")) for c in columns]))
    bits = F.conv(F.substring(row_digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return (rows.groupBy("_source_id", "_source_file")
            .agg(F.min("_source_row_number").alias("first_row"),
                 F.max("_source_row_number").alias("last_row"),
                 F.count("*").alias("rows_staged"),
                 F.sum(bits).alias("_bits"))
            .select("_source_id", "_source_file", "first_row", "last_row", "rows_staged",
                    F.md5(F.concat_ws(":", F.col("rows_staged").cast("string"), F.col("_bits").cast("string")))
                    .alias("content_hash")))


def already_loaded(audit: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content was staged before under any name (order of rows does not matter)."""
    return audit.join(ledger.select("content_hash").distinct(), "content_hash", "left_semi")


def source_paths(inputs: Mapping[str, str | Sequence[str]]) -> dict[str, list[str]]:
    return {sid: [paths] if isinstance(paths, str) else list(paths) for sid, paths in inputs.items()}
