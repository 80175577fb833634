"""Folders of markdown notes as memories and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import text as T


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """name (the file's, without its ending) and text of all .md files below the path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "").alias("file"), F.col("value").alias("text")).select(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("name"), "text")


def imported(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, links) of notes (name, text).

    A note's memory has its title (front matter, else the name), tags and body; a link goes from a note to the note that
    a [[wikilink]] names, whatever the case, and never to itself. Links to notes that are not there are left out; of notes
    whose names differ in case only, the first name is meant.
    """
    meta = notes.withColumn("meta", T.front_matter(F.col("text")))
    tags = F.when(F.map_contains_key("meta", F.lit("tags")), T.list_value(F.element_at("meta", F.lit("tags")))).otherwise(F.array().cast("array<string>"))
    memories = meta.select("name", F.coalesce(F.element_at("meta", F.lit("title")), "name").alias("title"), tags.alias("tags"), T.body(F.col("text")).alias("content"))
    known = notes.select(F.lower("name").alias("key"), "name").groupBy("key").agg(F.min("name").alias("to_name"))
    named = notes.select(F.col("name").alias("from_name"), F.explode(T.wikilinks(F.col("text"))).alias("target")).select("from_name", F.lower("target").alias("key"))
    links = named.join(known, "key").where(F.lower("from_name") != F.col("key")).select("from_name", "to_name", F.lit("RESONANT").alias("link_type")).distinct()
    return memories, links
