"""Sources and sinks: file listings, JSON-lines reports, CSV summaries, outlines of PDF files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirelake.functions.text import casefold
from quirelake.operators.nested import whole_json


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf", exclude: str | None = None) -> DataFrame:
    """(path, size, modified) of the files below a folder with a suffix in any letter case, but not below `exclude`; by folded path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = F.regexp_replace("path", "^file:/+", "/")
    out = files.where(F.lower(F.col("path")).endswith(suffix.lower()))
    if exclude is not None:
        out = out.where(~bare.startswith(exclude.rstrip("/") + "/"))
    return out.select(bare.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(casefold(F.col("path")), "path")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def looks_like_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(seq, source, doc): the rows of JSON-lines report files with a non-empty text as source; other lines are skipped.

    seq struct<start, row> orders the lines of one file: where their split of the file starts, and the row in it. Files are read by
    line, in splits, so a file may have any size.
    """
    at = F.struct(F.expr("input_file_block_start()").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.option("lineSep", "\n").text(path).select(at.alias("seq"), F.col("value").alias("line"))
    doc = whole_json(F.col("line"))
    kind = F.schema_of_variant(F.try_variant_get("doc", "$.source", "variant"))
    rows = lines.select("seq", doc.alias("doc")).where(kind == "STRING")
    return rows.select("seq", F.try_variant_get("doc", "$.source", "string").alias("source"), "doc").where("source != ''")


def write_summary(df: DataFrame, path: str) -> None:
    """CSV parts with a header that spreadsheet programs read as UTF-8: the mark goes before the first column's name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").csv(path)


def read_summary(spark: SparkSession, path: str, key: str = "source") -> DataFrame:
    df = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if key not in df.columns:
        raise ValueError(f"the summary has no column {key}")
    return df


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _OutlineReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        try:
            from pypdf import PdfReader
        except ImportError:
            yield partition.path, 0, None, None, None, "pypdf is not installed"
            return
        try:
            reader = PdfReader(partition.path)
            todo, seq = [(reader.outline, 1)], 0
            while todo:
                items, level = todo.pop()
                for i, item in enumerate(items):
                    if isinstance(item, list):
                        todo += [(items[i + 1 :], level), (item, level + 1)]
                        break
                    page = reader.get_destination_page_number(item)
                    seq += 1
                    yield partition.path, seq, str(item.get("/Title", "")), level, None if page is None or page < 0 else page + 1, None
        except Exception as e:  # a file that can't be read is a row with its reason
            yield partition.path, 0, None, None, None, f"{type(e).__name__}: {e}"


class OutlineSource(DataSource):
    """spark.read.format("pdf_outline").option("paths", "a.pdf;b.pdf"): outline rows in file order, one partition per file."""

    @classmethod
    def name(cls):
        return "pdf_outline"

    def schema(self):
        return "path string, seq bigint, title string, level int, page_number int, error string"

    def reader(self, schema):
        return _OutlineReader([p for p in self.options.get("paths", "").split(";") if p])
