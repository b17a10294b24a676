"""Sources: parquet tables, positioned text items, OCR paragraphs, lexicon files, settings and phoneme JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_word

ITEMS = "doc_id string, page_number int, item_seq int, str string, x double, y double, font_size double, width double, page_height double"
PARAGRAPHS = "doc_id string, page_number int, block_seq int, par_seq int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, page_width int, page_height int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_items(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Positioned text items; NUL characters and blank items go."""
    items = spark.read.format(kind).schema(ITEMS).load(path)
    return clean_items(items)


def clean_items(items: DataFrame) -> DataFrame:
    clean = items.withColumn("str", F.replace("str", F.lit("\u0000"), F.lit("")))
    return clean.where(F.col("str").isNotNull() & (F.trim(F.regexp_replace("str", r"\s+", " ")) != ""))


def ocr_paragraphs(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).schema(PARAGRAPHS).load(path)


def lexicon(lines: DataFrame) -> DataFrame:
    """Distinct normalised words of a one-word-a-line text (column value), sorted."""
    words = lines.select(normalise_word(F.col("value")).alias("word")).where(F.col("word").rlike("^[a-z'-]+$"))
    return words.distinct().orderBy("word")


def settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """Preferences of a settings file over defaults, as name and value."""
    stored = spark.read.text(path, wholetext=True).select(F.from_json("value", "preferences map<string,string>").alias("s")).select(F.coalesce("s.preferences", F.create_map().cast("map<string,string>")).alias("stored"))
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key("stored", k)), F.col("stored"))
    return stored.select(F.explode(merged).alias("name", "value"))


def phoneme_json(spark: SparkSession, path: str) -> DataFrame:
    """phoneme, ipa, total, grapheme, frequency, example from a JSON object keyed by phoneme."""
    kind = "map<string,struct<ipa_hint:string,total_frequency:bigint,graphemes:array<struct<g:string,freq:bigint,example:string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("phoneme", "x"))
    return rows.select("phoneme", F.col("x.ipa_hint").alias("ipa"), F.col("x.total_frequency").alias("total"), F.explode("x.graphemes").alias("g")).select("phoneme", "ipa", "total", F.col("g.g").alias("grapheme"), F.col("g.freq").alias("frequency"), F.col("g.example").alias("example"))


def write_text(df: DataFrame, path: str) -> None:
    """One text file of a report column `value`."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_settings(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


OCR_ERRORS = (
    ("OCR_CANCELLED", "cancel|annul"), ("OCR_RUNTIME_UNAVAILABLE", "worker is not defined|runtime"), ("OCR_NETWORK_ERROR", "network|fetch|offline"),
    ("OCR_LANGUAGE_DATA_UNAVAILABLE", "traineddata|language data"), ("OCR_CORE_LOAD_FAILED", "wasm|core"), ("OCR_LIBRARY_LOAD_FAILED", "import|module|load"),
)


def ocr_error(message):
    """A stable code for an error message: the first rule that matches."""
    out = F.lit("OCR_UNKNOWN_ERROR")
    for code, pattern in reversed(OCR_ERRORS):
        out = F.when(F.lower(message).rlike(pattern), code).otherwise(out)
    return out


#: Bytes of a table for every core, below which its few row groups are dealt over the cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few and small to be split; larger tables stay as they are read.

    A file of one row group is one task, however much work each row is. The rows are the same; only a table of under
    SPREAD_BYTES a core, by Catalyst's own estimate, is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SPREAD_BYTES * cores else df
