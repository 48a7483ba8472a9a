"""Documents from and to JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = {"jsonl": "jsonl", "json": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "tsv", "txt": "text"}


def format_of(path: str, override: str = "auto") -> str:
    """By the ending of the path, upper or lower case; ``override`` wins."""
    if override != "auto":
        if override not in FORMATS.values():
            raise ValueError(f"no such format: {override}")
        return override
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end not in FORMATS:
        raise ValueError(f"the format of {path} isn't known; name it")
    return FORMATS[end]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): raw lines numbered from 0 in each file, blank ones as well.

    A split's lines are consecutive. Their numbers are counted within the split;
    a sum over the splits before it, one row for each split, gives the rest.
    """
    m = F.col("_metadata")
    raw = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim("value").alias("line"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = splits.select("file", "block", "first", before.alias("before"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_number"), "line")


def read_jsonl(spark: SparkSession, path: str, text_field: str = "text", keep_line: bool = False) -> DataFrame:
    """(id, text, line_number[, line]).

    Blank lines are skipped but count. ``id`` is the field ``id`` where that is a
    whole number from 0, else the line number. Lines that aren't JSON objects and
    those without a string in ``text_field`` raise with their 1-based number.
    """
    v = F.try_parse_json("line")
    name = text_field.replace("\\", "\\\\").replace("'", "\\'")
    text = F.try_variant_get(v, f"$['{name}']", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))
    number = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant"))
    given = F.when(number == "BIGINT", F.try_variant_get(v, "$.id", "long"))
    where = F.concat(F.lit("line "), (F.col("line_number") + 1).cast("string"))
    checked = F.when(v.isNull(), F.raise_error(F.concat(where, F.lit(": not JSON"))).cast("string")).when(kind == "STRING", text).otherwise(F.raise_error(F.concat(where, F.lit(f": no text in {text_field}"))).cast("string"))
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    return rows.select(F.when(given >= 0, given).otherwise(F.col("line_number")).alias("id"), checked.alias("text"), "line_number", *(["line"] if keep_line else []))


def read_parquet(spark: SparkSession, path: str, text_column: str = "text", id_column: str = "id") -> DataFrame:
    """(id, text): null texts are empty; without a whole-number id column rows are numbered."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if kinds.get(text_column) != "string":
        raise ValueError(f"{text_column} has to be a string column of {path}")
    ident = F.col(f"`{id_column}`").cast("long") if kinds.get(id_column) in ("bigint", "int", "decimal(20,0)") else F.monotonically_increasing_id()
    return df.select(ident.alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))


def read_parquet_full(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """All columns; rows with null text are left out."""
    df = spark.read.parquet(path)
    if text_column not in df.columns:
        raise ValueError(f"{path} has no column {text_column}")
    return df.where(F.col(f"`{text_column}`").isNotNull())


def read_documents(spark: SparkSession, path: str, text_field: str = "text", format: str = "auto") -> DataFrame:
    kind = format_of(path, format)
    if kind == "jsonl":
        return read_jsonl(spark, path, text_field, keep_line=True)
    if kind == "parquet":
        return read_parquet_full(spark, path, text_field)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    return numbered_lines(spark, path).select(F.col("line_number").alias("id"), F.col("line").alias("text"), "line_number", "line").where(F.trim("text") != "")


def write_jsonl(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).write.json(path)


def write_lines(df: DataFrame, path: str, line_col: str = "line", order_col: str = "line_number") -> None:
    """The lines as they were read, in their order over the files written."""
    df.orderBy(order_col).select(F.col(line_col).alias("value")).write.text(path)


def write_parquet(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).write.parquet(path)


def write_parquet_full(df: DataFrame, path: str) -> None:
    """All columns, an empty table with its schema."""
    df.write.parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.json(path)
