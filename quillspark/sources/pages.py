"""Corpora: wikitext files, JSON lines of pages, windows and picks of lines; text and JSON sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path
from shutil import copyfileobj
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Picked lines are broadcast up to this many, joined by shuffle above.
BROADCAST_LINES = 200_000
#: Lines of an unpacked file handed on at a time.
UNPACKED_LINES = 10_000


def wikitext_files(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """(path, title, wikitext): one row per ``.wikitext`` file of a folder, or for one file; title is the file's name.

    ``ordered`` gives the files in order of their names, by a sort over ranges.
    """
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.wikitext")
    file = F.col("_metadata.file_path")
    name = F.regexp_replace(F.regexp_extract(file, "([^/]+)$", 1), "\\.wikitext$", "")
    out = rows.select(file.alias("path"), F.translate(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "_", " ").alias("title"), F.col("value").alias("wikitext"))
    return out.orderBy("title", "path") if ordered else out


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of ``.zst`` files, each unpacked as a stream by one task; 1-based within a file."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()), read_across_frames=True)
                lines, at = io.TextIOWrapper(reader, encoding="utf-8", errors="replace", newline="\n"), 0
                while part := list(islice(lines, UNPACKED_LINES)):
                    values = [x.removesuffix("\n").removesuffix("\r") for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(at + 1, at + len(part) + 1), pa.int64()), pa.array(values)], names=["path", "line", "value"])
                    at += len(part)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select("path", "content").mapInArrow(unpack, "path string, line bigint, value string")


def piped_lines(spark: SparkSession, stream: IO[str], folder: str) -> DataFrame:
    """(line, value) of a stream such as standard input, which only the driver can read: copied into ``folder``, a
    shared one, a block at a time, and read back from there by all tasks."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / "piped.txt", "w", encoding="utf-8", newline="\n") as out:
        copyfileobj(stream, out)
    return numbered_lines(spark, folder)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file or folder, 1-based in order; .bz2 and .gz are read as they are.

    Lines are counted per partition; only one count per partition is gathered.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_i"), "value")
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND((1 << 33) - 1)
    # One row per partition of the scan, so one task suffices for the running sum.
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(part.alias("_p")).count().select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").select((place + F.col("_o") + 1).alias("line"), "value")


def _field(v: Column, *paths: str, to: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, to) for p in paths])


def page_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of JSON lines (line, value): arrays [id, title, rev_id, text] or objects with those fields.

    pages: (line, page_id, title, rev_id, wikitext); rejects: (line, kind, error). Blank lines are neither.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    v = F.col("_v")
    got = rows.select(
        "line", v.isNull().alias("_bad"), _field(v, "$[0]", "$.id", to="bigint").alias("page_id"), _field(v, "$[1]", "$.title").alias("title"),
        _field(v, "$[2]", "$.rev_id", "$.timestamp").alias("rev_id"), _field(v, "$[3]", "$.wikitext").alias("wikitext"),
    )
    whole = ~F.col("_bad") & F.col("page_id").isNotNull() & F.col("wikitext").isNotNull()
    pages = got.filter(whole).drop("_bad")
    error = F.when(F.col("_bad"), "not JSON").when(F.col("page_id").isNull(), "no page id").otherwise("no text")
    rejects = got.filter(~whole).select("line", F.when(F.col("_bad"), "invalid_json").otherwise("invalid_record").alias("kind"), error.alias("error"))
    return pages, rejects


def line_window(lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines from start to end, 1-based and inclusive."""
    out = lines
    if start is not None:
        out = out.filter(F.col("line") >= start)
    if end is not None:
        out = out.filter(F.col("line") <= end)
    return out


def pick_lines(lines: DataFrame, wanted: Iterable[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the wanted lines, the wanted numbers that are not there)."""
    spark = lines.sparkSession
    if not isinstance(wanted, DataFrame):
        numbers = sorted(set(wanted))
        wanted = spark.createDataFrame([(int(i),) for i in numbers], "line bigint")
        if len(numbers) <= BROADCAST_LINES:
            wanted = F.broadcast(wanted)
    return lines.join(wanted, "line", "left_semi"), wanted.join(lines.select("line"), "line", "left_anti")


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One line of JSON-escaped text per page, as texts hold line breaks."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_tokens(tokens: DataFrame, path: str, node_bits: int = 20) -> None:
    """The token table as Parquet, rows of a page in order, so that reads by page skip row groups; a page with more
    than 2**node_bits nodes is divided among tasks and files."""
    tokens.repartition("page_id", F.shiftright("node_id", node_bits)).sortWithinPartitions("page_id", "node_id").write.mode("overwrite").parquet(path)
