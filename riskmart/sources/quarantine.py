"""CSV reading that survives bad rows (SRC-1, SRC-9, VAL-7).

Every line of the files is either the header, blank, a row, or in the quarantine with
its file, byte offset and reason; nothing is dropped. Files are read as lines, so
they split and any number of tasks share a large one; lines are judged and parsed by
built-in functions. Only the offsets need the order of lines: they are added up inside
a task over line lengths, and every part of a file gets the bytes of the parts before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..session import materialize
from .readers import null_tokens

BAD = "__bad"
SLOT = "__row"
QUARANTINE = "file string, offset long, reason string, line string"


def _plain(line: Column) -> Column:
    """The line without what stands in quotes."""
    return F.regexp_replace(line, '"(?:[^"]|"")*+"', "")


def reason(line: Column, fields: int, sep: str, parsed: Column) -> Column:
    """Why a line is no row, or null."""
    count = F.size(F.split(_plain(line), "\\Q" + sep + "\\E", -1))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    return (F.when(quotes % 2 == 1, "unclosed quote").when(count < fields, "too few fields")
            .when(count > fields, "too many fields").when(parsed[BAD].isNotNull(), "wrong type"))


def _places(batches):
    """Bad lines with the bytes before them in their part of the file."""
    part, at = None, 0
    for batch in batches:
        size = batch.column(0).to_numpy()
        file, block = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        begin = np.empty(len(size), dtype=np.int64)
        cuts = [0, *[i for i in range(1, len(size)) if block[i] != block[i - 1] or file[i] != file[i - 1]], len(size)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if (file[a], block[a]) != part:
                part, at = (file[a], block[a]), 0
            run = np.cumsum(size[a:b])
            begin[a:b] = at + run - size[a:b]
            at += int(run[-1])
        bad = pa.array(~np.asarray(batch.column(3).is_null()))
        kept = pa.RecordBatch.from_arrays([pa.array(begin), *batch.columns[1:]],
                                          names=["offset", "file", "block", "reason", "line"])
        yield kept.filter(bad)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     tokens: Sequence[str] = K.NULL_TOKENS, sep: str = ",", recursive: bool = False,
                     name_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the CSV files below ``path``.

    A row has as many fields as the schema, closed quotes and values of the schema's
    types; quotes are doubled inside quoted fields. Without a schema the columns are those
    of the header, as text. Lines equal to the header are headers; all files share one.
    Empty cells and ``tokens`` are null. Every other line is one row of the quarantine: file,
    offset (bytes from the start of the file), reason, line. A line break inside quotes ends
    the line, and both parts are in the quarantine. Blank lines are neither. Files without
    lines give two empty tables.
    """
    def options(r):
        if recursive:
            r = r.option("recursiveFileLookup", True)
        return r.option("pathGlobFilter", name_glob) if name_glob else r

    if schema is None:
        names = options(spark.read.option("header", True).option("sep", sep)).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    tested = T.StructType(schema.fields + [T.StructField(BAD, T.StringType())])
    text = options(spark.read.option("lineSep", "\n")).text(path).select(
        (F.octet_length("value") + 1).cast("long").alias("size"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"),
        F.regexp_replace("value", "\r$", "").alias("line"))
    rule = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    # text cells that stand for null are emptied by the parser's types only after the check
    parsed = F.from_csv("line", tested.simpleString()[len("struct<"):-1].replace(":", " "), rule)
    header = F.replace(F.col("line"), F.lit('"')) == F.lit(sep.join(schema.names))
    skip = header | (F.trim("line") == "")
    judged = materialize(
        text.withColumn(SLOT, parsed)
        .withColumn("reason", F.when(~skip, reason(F.col("line"), len(schema.names), sep, F.col(SLOT))))
        .withColumn("row", ~skip & F.col("reason").isNull())
        .withColumn(SLOT, F.when(F.col("row"), F.col(SLOT)))
        .withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line")))
        .withColumn("seq", F.monotonically_increasing_id()), "csv-checked")
    rows = null_tokens(judged.where("row").select(*[F.col(SLOT)[c].alias(c) for c in schema.names]), tokens)
    # the parts of a file are few: its bytes over the split size
    parts = judged.groupBy("file", "block").agg(F.sum("size").alias("bytes"), F.max("whole").alias("whole"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the line reader passes over a byte order mark (3 bytes); a last line without an end counts one too many
    mark = F.when(F.col("whole") - F.sum("bytes").over(Window.partitionBy("file")) >= 2, 3).otherwise(0)
    parts = parts.select("file", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + mark).alias("base"))
    hurt = judged.where("reason IS NOT NULL").select("file", "block").distinct()
    # order inside a part is that of reading; only parts with bad lines are looked at again
    lines = (judged.select("size", "file", "block", "reason", "line", "seq").join(hurt, ["file", "block"], "left_semi")
             .repartition("file", "block").sortWithinPartitions("file", "block", "seq")
             .select("size", "file", "block", "reason", "line"))
    found = lines.mapInArrow(_places, "offset long, file string, block long, reason string, line string")
    bad = found.join(parts, ["file", "block"]).select("file", (F.col("offset") + F.col("base")).alias("offset"),
                                                      "reason", "line")
    return rows, bad
