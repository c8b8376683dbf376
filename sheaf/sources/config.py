"""Selector configuration, stop words, résumés and section status as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import compact
from sheaf.session import dealt

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def save_texts(rows: DataFrame, path: str, *keys: str) -> None:
    """``rows(keys.., value)`` as text files, one for each row where the keys name it, in folders named by the keys.

    Opening and closing files is the work here, so rows are dealt to all partitions however few bytes they hold, and every
    task puts its own files in place instead of leaving them all to the driver.
    """
    rows = dealt(rows, F.xxhash64(*keys))  # dealt by the keys, groups of them would stay in the few partitions they came in
    rows.write.partitionBy(*keys).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``, a row per text file below ``path``.

    Spark counts every file as some MB, so that small ones would make a task of a few files each, and it lists their folders in ten thousand
    tasks; both get as many tasks as the session has partitions.
    """
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    former = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(parts), int(former))))
    try:
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)  # folder names are not looked at for values
    finally:
        spark.conf.set(_LISTING, former)
    return files.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).coalesce(int(parts))


def selectors(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """``(domain, field, selectors)`` of a JSON object (per file, or per line) domain -> field -> text, list or flag.

    Single texts become lists of one, so all fields read alike.
    """
    doc = spark.read.text(path, wholetext=not by_line)
    domains = doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("domain", "fields"))
    fields = domains.select("domain", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "value"))
    as_list = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>"))
    return fields.select("domain", "field", F.coalesce(as_list, F.array("value")).alias("selectors"))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``(term)`` of a text file with one term per line, normalised and distinct."""
    term = F.lower(compact(F.col("value")))
    return spark.read.text(path).select(term.alias("term")).where("term <> ''").distinct()


def resumes(spark: SparkSession, path: str) -> DataFrame:
    """``(resume_id, body, source_modified)``: one row per markdown file."""
    return _files(spark, path).select(F.col("file_path").alias("resume_id"), F.col("value").alias("body"), F.col("modified").alias("source_modified"))


def section_status(spark: SparkSession, path: str) -> DataFrame:
    """``(section, status, last_updated, filename)`` of a JSON object of sections."""
    doc = _files(spark, path)
    entries = doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("section", "value"))
    entry = F.from_json("value", "status string, last_updated string, filename string")
    rows = entries.where(F.col("value").startswith("{")).select("section", entry.alias("e"))
    return rows.select(
        "section",
        F.coalesce("e.status", F.lit("Not Started")).alias("status"),
        F.try_to_timestamp("e.last_updated").alias("last_updated"),
        F.col("e.filename").alias("filename"),
    )


def save_section_status(status: DataFrame, path: str) -> None:
    status.write.mode("overwrite").parquet(path)
