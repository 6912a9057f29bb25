"""Reading as things are: refused values (S1, C3, C5), order of ingest (S2, J1,
C6) and encodings by file (S12).

``quarantine`` reads every field as text, converts what converts, and keeps what
doesn't as rows of its own (row, column, raw value, reason) beside the clean rows.
Both come from one tagged table, so their counts add up to the input.

``read_ordered`` gives each row where it stood: file, block in the file, place in
the block. The triple sorts as the rows were read one after the other, in whatever
order and number of tasks Spark reads them; first and last rows of a key need
nothing more. ``row_numbers`` makes dense numbers of it without a global sort:
blocks are counted, the few counts are summed up, and each row adds its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from demandlens.functions.text import coerce_int, strip_text
from demandlens.operators.cleaning import load_clean
from demandlens.session import checkpointed
from demandlens.sources.io import ENCODINGS, SPARK_NAMES, read_csv_typed

CORRUPT = "_corrupt_record"
ORDINAL = "ordinal"
REJECTS = "array<struct<column:string,raw:string,reason:string>>"


# --- refused values ------------------------------------------------------

def _converted(c: str, kind: str) -> tuple[Column, str]:
    """(value of a text field, what to say of one that has none)."""
    text = F.col(c)
    if kind == "bigint":
        return coerce_int(c), "no whole number"
    if kind == "int":
        return coerce_int(c).try_cast("int"), "no whole number in range"
    if kind == "double":
        return text.try_cast("double"), "no number"
    if kind == "timestamp":
        return F.try_to_timestamp(strip_text(text)), "no date"
    if kind == "date":
        return F.try_to_timestamp(strip_text(text)).cast("date"), "no date"
    if kind == "string":
        return text, ""
    raise ValueError(f"type {kind!r} is not supported")


def tagged(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The frame with its text columns converted by ``types`` (the others stay) and
    ``rejects``: what did not convert. Null and blank fields are missing values,
    not refused ones. A row with ``_corrupt_record`` is refused whole."""
    rejects, converted = [], {}
    for c, kind in types.items():
        value, reason = _converted(c, kind)
        converted[c] = value
        if kind != "string":
            bad = F.col(c).isNotNull() & (strip_text(F.col(c)) != "") & value.isNull()
            rejects.append(F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"), F.lit(reason).alias("reason"))))
    found = F.array_compact(F.array(*rejects)) if rejects else F.array().cast(REJECTS)
    if CORRUPT in df.columns:
        whole = F.struct(F.lit(None).cast("string").alias("column"), F.col(CORRUPT).alias("raw"), F.lit("wrong number of fields").alias("reason"))
        found = F.when(F.col(CORRUPT).isNotNull(), F.array(whole)).otherwise(found)
    out = df.withColumn("rejects", found.cast(REJECTS))
    return out.withColumns(converted).drop(CORRUPT)


def quarantine(df: DataFrame, types: Mapping[str, str], key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean rows, refused values): one pass writes the tagged rows, both results
    read them. A refused value has the ``key`` columns of its row, converted."""
    rows = checkpointed(tagged(df, types))
    bad = rows.where(F.size("rejects") > 0).select(*key, F.explode("rejects").alias("r")).select(*key, "r.*")
    return rows.where(F.size("rejects") == 0).drop("rejects"), bad


def balance(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows read, clean and refused, and refused values, in one aggregate."""
    n = F.size("rejects")
    return tagged(df, types).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(n == 0, 1)).alias("clean"),
                                 F.count(F.when(n > 0, 1)).alias("refused"), F.coalesce(F.sum(n), F.lit(0)).alias("refused_values"))


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = ENCODINGS[0], header: bool = True) -> DataFrame:
    """A CSV's fields as text, and the line of a row with more or fewer of them
    in ``_corrupt_record``. Columns aren't pruned: a reader that parses fewer of
    them takes some broken lines for whole."""
    schema = StructType([StructField(c, StringType()) for c in (*columns, CORRUPT)])
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", True).option("columnPruning", False).option("encoding", SPARK_NAMES.get(encoding, encoding)).csv(path))


# --- order of ingest -----------------------------------------------------

def read_ordered(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """A table with ``ordinal``, a struct (file, block, row) that sorts as the
    rows stand: by file name, then by place in the file."""
    reader = spark.read.options(**options).format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    # Parquet knows a row's number in its file; in text a task reads its blocks
    # from their start on, so its running number sorts the rows of a block
    parquet = fmt == "parquet"
    block = F.lit(0).cast("bigint") if parquet else F.col("_metadata.file_block_start")
    row = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row")).alias(ORDINAL))


def row_numbers(df: DataFrame, ordinal: str = ORDINAL, out: str = "row_number") -> DataFrame:
    """Dense numbers from 0 of all rows of ``read_ordered``, in ingest order: rows
    before a block plus the place in it. The table is written once, so that both reads of it see the same rows; the
    window is over the blocks, of which there are as many as Spark lists anyway."""
    rows = checkpointed(df)
    blocks = rows.groupBy(F.col(f"{ordinal}.file").alias("_file"), F.col(f"{ordinal}.block").alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(f"{ordinal}.row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_file", "_block", "_first", before.alias("_before"))
    here = (F.col(f"{ordinal}.file") == F.col("_file")) & (F.col(f"{ordinal}.block") == F.col("_block"))
    # within a block the running numbers have no gaps
    return (rows.join(starts, here).withColumn(out, F.col("_before") + F.col(f"{ordinal}.row") - F.col("_first"))
            .drop("_file", "_block", "_first", "_before"))


def first_rows(df: DataFrame, n: int, ordinal: str = ORDINAL) -> DataFrame:
    """The first n rows as they stand in the files: a top-n of n rows a task."""
    return df.orderBy(ordinal).limit(n)


# --- encodings -----------------------------------------------------------

def files_by_encoding(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path by the first encoding that fits all of a file's
    lines. UTF-8 is judged by its bytes, so a file that holds U+FFFD itself is not
    taken for damaged. The list is one of files, as long as Spark's own."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    files = lines.groupBy("file").agg(F.min("ok").alias("ok")).collect()
    out: dict[str, list[str]] = {}
    for f in sorted(files, key=lambda r: r.file):
        out.setdefault(ENCODINGS[0] if f.ok else ENCODINGS[-1], []).append(unquote(f.file))
    return out


def read_csv_mixed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of CSV files, each decoded by its own encoding."""
    parts = [read_csv_typed(spark, files, schema, enc) for enc, files in files_by_encoding(spark, path).items()]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_upload(spark: SparkSession, path: str, fields: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """An uploaded CSV made ready for analysis: the files' ``fields`` as text,
    each file by its encoding, then ``cleaning.load_clean`` on the ``columns``."""
    return load_clean(read_csv_mixed(spark, path, ", ".join(f"`{f}` string" for f in fields)), columns)
