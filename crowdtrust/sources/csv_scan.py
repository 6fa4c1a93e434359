"""CSV scans that Spark's own reader does not offer: quoted text with newlines
read by many tasks (IO3), and folders of files whose headers differ (IO9, IO10).

Both start from ``spark.read.text``, which deals a file's byte ranges to
different tasks and says for each line from which file and range it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtrust.operators.votes import BROADCAST_ROW_LIMIT
from crowdtrust.session import checkpoint_root

QUOTE = '"'
#: RFC 4180: quotes inside quoted fields are doubled.
QUOTED = {"escape": QUOTE, "multiLine": "true"}
_PIECES = "file string, block long, kind int, first boolean, text string"
WHOLE, HEAD, THROUGH, TAIL = 0, 1, 2, 3


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines, cut at ``\\n`` alone; ``block`` is where the byte range begins in its file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the (counted) rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROW_LIMIT else df


def _pieces(kinds: tuple[int, ...]):
    """Puts the lines of each byte range together to records.  A line ends a
    record if the quotes so far, from the beginning of the file on, are even
    in number.  Of a record that lies in several ranges, each has a piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here = None          # the byte range
        open_lines: list[str] = []  # lines of the record that is not complete
        odd = continued = first = False
        out: list[tuple] = []

        def put(kind, text):
            if kind in kinds:
                out.append((*here, kind, first, text))

        def leave():
            if open_lines:
                put(THROUGH if continued else TAIL, "\n".join(open_lines))

        for batch in batches:
            file, block = batch.column("file"), batch.column("block").to_numpy()
            codes = file.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(codes) != 0)]).tolist() if len(block) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
                key = (file[lo].as_py(), int(block[lo]))
                if key != here:
                    leave()
                    here, open_lines = key, []
                    odd = continued = batch.column("odd")[lo].as_py()
                    first = key[1] == 0
                values = batch.column("value").slice(lo, hi - lo)
                quotes = np.cumsum(pc.count_substring(values, QUOTE).to_numpy()) + int(odd)
                lines, at = values.to_pylist(), 0
                for end in np.flatnonzero(quotes % 2 == 0).tolist():
                    text = "\n".join([*open_lines, *lines[at: end + 1]]) if open_lines or end > at else lines[at]
                    put(HEAD if continued else WHOLE, text)
                    open_lines, continued, first, at = [], False, False, end + 1
                open_lines += lines[at:]
                odd = bool(quotes[-1] % 2)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _types(), strict=True)], names=list(_names()))
                out = []
        leave()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _types(), strict=True)], names=list(_names()))

    def _names():
        return ("file", "block", "kind", "first", "text")

    def _types():
        import pyarrow as pa

        return pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()

    return run


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(text, first): the records of quoted CSV files, newlines inside quotes
    kept; ``first`` marks a file's first record.  Quotes stand only around
    whole fields and are doubled inside them, as :func:`write_table` writes
    them.  The byte ranges of a file are read by different tasks:

    1. quotes are counted in each range; the sums over the ranges before it
       say whether a range begins inside quotes (a row per range);
    2. each task puts the lines of its ranges together;
    3. pieces of records that cross a boundary (two per range at most, or one
       that goes through) are gathered.
    """
    lines = text_lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(QUOTE), F.lit("")))
    ranges = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1
    ranges = _checkpointed(ranges.select("file", "block", odd.alias("odd")))
    lines = lines.join(F.broadcast(ranges), ["file", "block"]).select("value", "file", "block", "odd")  # the lines keep their order
    whole = lines.mapInArrow(_pieces((WHOLE,)), _PIECES).select("text", "first")
    parts = _checkpointed(lines.mapInArrow(_pieces((HEAD, THROUGH, TAIL)), _PIECES))
    # a piece belongs to the record that the last TAIL at or before it began; in a range HEAD comes before TAIL.
    # Numbered without the texts: a few numbers per range
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    tail = (F.col("kind") == TAIL).cast("long")
    number = parts.select("file", "block", "kind").withColumn("record", F.sum(tail).over(order))
    gathered = parts.join(number, ["file", "block", "kind"]).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.bool_or("first").alias("first"))
    return whole.unionByName(gathered.select("text", "first"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO3: rows of CSV files with a header each, fields quoted where they
    hold newlines or quotes; the rows that Spark's ``multiLine`` reader gives,
    which reads a file in one task."""
    records = quoted_records(spark, path).filter(~F.col("first"))
    # where lines end in CRLF, those inside quotes are read as LF, too
    text = F.when(F.endswith("text", F.lit("\r")), F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    parsed = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), QUOTED)
    return records.filter(F.trim(text) != "").select(parsed.alias("r")).select("r.*")


def read_csv_by_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields): every row of the CSV files as a map from the names in
    its own file's header to its (string) values; an empty value is null.

    The headers are data: the first line of each file, a row per file, joined
    to the file's other lines.  So files may have different columns in
    different order, and there may be any number of them.  Rows are single
    lines (quoted newlines: :func:`read_quoted_csv`)."""
    lines = text_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    at = F.monotonically_increasing_id()
    heads = _checkpointed(lines.filter("block = 0").select("file", F.struct(at.alias("at"), "value").alias("l"))
                          .groupBy("file").agg(F.min("l").alias("l")).select("file", F.col("l.value").alias("head")))
    width = heads.agg(F.max(F.length("head") - F.length(F.replace(F.col("head"), F.lit(","), F.lit("")))) + 1).first()[0] or 1
    cells = ", ".join(f"c{i} string" for i in range(width))

    def values(c):
        one = F.from_csv(c, cells, {"escape": QUOTE})
        return F.array(*[one[f"c{i}"] for i in range(width)])

    names = F.filter(values(F.regexp_replace("head", "^﻿", "")), lambda n: n.isNotNull())
    named = heads.select("file", "head", F.transform(names, F.trim).alias("names"))
    rows = lines.join(_small(named), "file").filter((F.col("value") != F.col("head")) & (F.trim("value") != ""))
    # a caller's cast may be evaluated together with the filter: of a header it then sees nulls
    rows = rows.withColumn("cells", values(F.when(F.col("value") != F.col("head"), F.col("value"))))
    # of two columns of the same name the first counts
    first = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.array_position("names", F.get("names", i)) == i + 1)
    fields = F.map_from_entries(F.transform(first, lambda i: F.struct(F.get("names", i).alias("k"), F.get("cells", i).alias("v"))))
    return rows.filter(F.size("names") > 0).select("file", fields.alias("fields"))


def named_file(file, suffix: str):
    """The file's own name, or the name of the folder that Spark wrote under such a name: ``<name><suffix>``."""
    return F.regexp_extract(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "([^/]+" + suffix.replace(".", "\\.") + ")(/[^/]*)?$", 1)
