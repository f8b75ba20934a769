"""Sources (SRC-*): file readers and view registration.

Readers take explicit schemas where one is known; schema inference on CSV is
an extra full pass over the input and is only offered as an option.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K


def null_tokens(df: DataFrame, tokens: Sequence[str] = K.NULL_TOKENS,
                cols: Iterable[str] | None = None) -> DataFrame:
    """Text cells equal to any null token become null (SRC-1).

    The CSV reader's ``nullValue`` takes only one token, so the set is applied
    as a column expression on the text columns.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(cols) & text if cols is not None else text
    return df.select(*[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in targets
                       else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             tokens: Sequence[str] = ("?",), infer: bool = False, recursive: bool = False,
             name_glob: str | None = None) -> DataFrame:
    """CSV with header and null tokens (SRC-1); ``recursive`` + ``name_glob``
    find files by name anywhere below ``path`` (SRC-2)."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    return null_tokens(r.csv(path), tokens)


def raw_text_schema(columns: Sequence[str] = K.RAW_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def align_raw(raw: DataFrame, extra: Sequence[str] = ("admitted_at",)) -> DataFrame:
    """Records of any source aligned to the 50 raw columns, as text (SRC-8).

    Columns the source does not supply are filled: ``?`` for weight, payer and
    specialty, ``No`` for medications, null otherwise. ``extra`` columns (the
    encounter time) are kept after them with their own type.
    """
    cols = []
    for c in K.RAW_COLUMNS:
        if c in raw.columns:
            cols.append(F.col(c).cast("string").alias(c))
        elif c in K.RAW_FILL_UNKNOWN:
            cols.append(F.lit("?").alias(c))
        elif c in K.RAW_FILL_NO:
            cols.append(F.lit("No").alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    cols += [F.col(c) for c in extra if c in raw.columns]
    return raw.select(*cols)


def to_bronze(raw: DataFrame) -> DataFrame:
    """Raw records aligned to the raw columns, as text, with an ingest
    timestamp (SRC-9)."""
    return align_raw(raw).withColumn("ingested_at", F.current_timestamp())


def code_sections(spark: SparkSession, path: str) -> DataFrame:
    """Stacked code tables in one text file -> (section, id, description) (SRC-3).

    A section starts at a header line (first field not a number); blank and
    ``,`` separator lines are skipped; descriptions may hold quoted commas and
    leading blanks; line ends may be CRLF. Each file is one row of
    ``wholetext``, and a code-table file is a fixed small file.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))
    first = F.trim(F.split("line", ",")[0])
    is_row = first.rlike(r"^[0-9]+$")
    is_header = (~is_row) & (F.trim("line") != "") & (F.trim("line") != ",")
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("section", F.last(F.when(is_header, first), ignorenulls=True).over(w))
    rows = tagged.where(is_row).select(
        "section", F.from_csv("line", "id string, description string").alias("r"))
    return rows.select("section", F.col("r.id").cast("int").alias("id"),
                       F.trim(F.col("r.description")).alias("description"))


def parquet_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the ``*.parquet`` files and directories directly under ``root``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n[:-len(".parquet")] for n in names if n.endswith(".parquet"))


def register_views(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> list[str]:
    """One temp view per Parquet table under ``root``, by default all of them (SRC-6)."""
    out = []
    for n in names if names is not None else parquet_tables(spark, root):
        spark.read.parquet(f"{root.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)
        out.append(n)
    return out


def stream_source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  max_files: int | None = None) -> DataFrame:
    """File-source stream of new records (SRC-7, STR-1)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)
