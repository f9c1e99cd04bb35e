"""Sources: labelled CSV corpora, term files, content-addressed file scans, JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVAL = "text string, label string, `group` string, note string, public_label string"
REQUEST = "content string, content_type string, content_id string, request_id string, user_id string, _bad string"


def labelled_csv(spark: SparkSession, path: str, schema: str = EVAL) -> DataFrame:
    """Blanks stay strings; texts may hold line ends; the file's name is kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\0").schema(schema).csv(path)
    return df.na.fill("").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def term_file(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """One term per line; blank lines and those that begin with # do not count."""
    t = F.trim("value")
    return spark.read.text(path).where((t != "") & ~t.startswith("#")).select((F.lower(t) if lower else t).alias("term")).distinct()


def files_by_content(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Every file below a folder once, by content; the first path wins; larger ones than ``cap`` bytes are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df if cap is None else df.where(F.col("length") <= cap)
    df = df.withColumn("sha256", F.sha2("content", 256))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("sha256").orderBy("path"))).where("_r = 1").drop("_r")


def requests(raw: Column, surfaces: tuple[str, ...]) -> tuple[Column, Column]:
    """A JSON request as a struct, and what is wrong with it (null: nothing)."""
    r = F.from_json(raw, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    wrong = F.when(r["_bad"].isNotNull() | r.isNull(), "not JSON").when(F.coalesce(F.trim(r["content"]), F.lit("")) == "", "content is required").when(~F.coalesce(r["content_type"].isin(*surfaces), F.lit(False)), "unknown content_type")
    return r, wrong
