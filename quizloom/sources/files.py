"""Question banks, page texts and table snapshots as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANK = (
    "question_type string, section string, number_in_section int, page_number int, stem string, source_file string, confidence double,"
    " tags array<string>, options array<struct<id:string,text:string>>, subparts array<struct<id:string,prompt:string>>"
)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A JSON question bank (an array of items a file, or an object with a questions array); the schema is fixed, so nothing is inferred.

    Damaged files give a row of nulls with _corrupt set to their text.
    """
    raw = spark.read.schema(f"{BANK}, questions array<struct<{_struct(BANK)}>>, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    inner = raw.filter("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*").withColumn("_corrupt", F.lit(None).cast("string"))
    return raw.filter("questions IS NULL").drop("questions").unionByName(inner)


def _struct(schema: str) -> str:
    out, depth = "", 0
    fields = []
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = out.strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            out = ""
        else:
            out += c
    return ",".join(fields)


def read_pages(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, page_no, text): text files under a folder, pages parted by form feeds; one task a file, files in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    pages = F.posexplode(F.split(F.decode("content", "UTF-8"), "\f"))
    return files.select(F.col("path").alias("file"), pages.alias("at", "text")).select("file", (F.col("at") + 1).alias("page_no"), "text")


def content_hashes(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(file, length, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """The next version of a table; with a partition column only the partitions that df holds are replaced, so a rerun changes nothing."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report that was written as one JSON file (or as lines); give a schema to infer nothing."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
