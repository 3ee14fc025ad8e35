"""Scans. Every reader takes an explicit schema or a fixed layout; none infers one from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double,absolute_start:double,absolute_end:double,probability:double>"
SAMPLE = f"id string, video string, label string, text string, word_count bigint, language string, source_video string, source_video_id string, clip_start double, clip_end double, words array<{WORD}>, num_frames int, target_fps double, roi_size int"
TRANSCRIPT = f"video_id string, video_path string, transcript string, words array<{WORD}>, word_count bigint, segment_count bigint, language string"


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Tolerant JSON; a broken document gives a row with only _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def samples(spark: SparkSession, metadata: str, videos: str, least_bytes: int = 100_000) -> DataFrame:
    """Rows whose video exists with at least `least_bytes` and whose text is not empty; counts and language filled."""
    rows = json_rows(spark, metadata, SAMPLE).where("_corrupt_record is null and video is not null and trim(text) <> ''").drop("_corrupt_record")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(videos).select(F.element_at(F.split("path", "/"), -1).alias("_name"), "length")
    rows = rows.withColumn("_name", F.element_at(F.split("video", "/"), -1)).join(files.where(F.col("length") >= least_bytes), "_name", "left_semi")
    words = F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), ""))
    return rows.withColumns({"word_count": F.coalesce("word_count", words.cast("bigint")), "language": F.coalesce("language", F.lit("unknown"))}).drop("_name")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def text_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """File (stem) and text, one row a .txt file."""
    read = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive)
    return read.text(path).select(stem(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def labelled_videos(spark: SparkSession, videos: str, labels: str) -> DataFrame:
    """Videos with a label file of the same stem and a text."""
    v = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(videos).select(stem(F.col("path")).alias("file"), F.col("path").alias("video"), "length")
    return v.join(text_files(spark, labels, False), "file").where("trim(text) <> ''")


def text_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Non-empty lines in order of file and place, at most `most`."""
    x = text_files(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    return x.orderBy("file", "pos").limit(most) if most is not None else x


def media_files(spark: SparkSession, path: str, suffixes: list[str], most: int | None = None) -> DataFrame:
    """Path, length and time of files with a suffix, sorted."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    x = x.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes])).orderBy("path")
    return x.limit(most) if most is not None else x


def ngram_model(spark: SparkSession, path: str) -> DataFrame:
    """Words (array) and n from JSON maps with tab-joined keys."""
    x = json_rows(spark, path, "unigrams map<string,bigint>, bigrams map<string,bigint>, trigrams map<string,bigint>")
    return x.select(F.explode(F.map_concat(*[F.coalesce(c, F.create_map().cast("map<string,bigint>")) for c in ("unigrams", "bigrams", "trigrams")])).alias("key", "n")).select(F.split("key", "\t").alias("words"), "n")


def placeholders(spark: SparkSession) -> DataFrame:
    """Five fixed samples."""
    texts = ["hello", "world", "how are you", "thank you", "goodbye"]
    return spark.createDataFrame([(f"placeholder_{i}", f"placeholder_{i}.npy", x, len(x.split())) for i, x in enumerate(texts)], "id string, video string, text string, word_count long")
