"""What is said about documents: scopes, labels, titles, import status; words as they are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import every

# Labels by quality.
QUALITY_LABELS = {"good": "Extraction stable", "partial": "Extraction partielle", "ocr": "OCR local"}
QUALITY_OTHER = "PDF scanné détecté"
SHORT_LABELS = {"partial": "partiel", "poor": "scanné", "ocr": "ocr"}
COLOURING_TOKEN = r"\s+|\p{L}+(?:['’]\p{L}+)?|[0-9]+|[^\s\p{L}0-9]"


def scope_pages(pages: DataFrame, id_col: str, page_col: str, scope: str = "document") -> DataFrame:
    """current-page: the first page of each document; anything else: all. A document's pages have distinct numbers."""
    if scope != "current-page":
        return pages
    first = pages.groupBy(id_col).agg(F.min(page_col).alias(page_col))
    return pages.join(first, [id_col, page_col], "left_semi")


def _chosen(value: Column, labels: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, label in labels.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def quality_label(quality: Column) -> Column:
    return _chosen(quality, QUALITY_LABELS, QUALITY_OTHER)


def recent_label(n_pages: Column, quality: Column, formula_blocks: Column, flagged_blocks: Column) -> Column:
    maths = F.when(formula_blocks > 0, F.concat(F.lit(" - maths "), formula_blocks.cast("string"))).when(flagged_blocks > 0, " - à vérifier").otherwise("")
    return F.concat(n_pages.cast("string"), F.lit(" page(s) - "), _chosen(quality, SHORT_LABELS, "ok"), maths)


def recent_title(file_name: Column) -> Column:
    """The file name without .pdf, with spaces for _ and -."""
    return F.trim(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), "[_-]+", " "))


def import_status(quality: Column, formula_blocks: Column, confidence: Column) -> Column:
    sure = F.when(confidence.isNotNull() & ~F.isnan(confidence.cast("double")), F.concat(F.lit(" Confiance moyenne OCR : "), F.floor(confidence + 0.5).cast("string"), F.lit("%."))).otherwise("")
    return (
        F.when(quality == "ocr", F.concat(F.lit("Version OCR locale générée."), sure))
        .when(quality == "poor", "PDF scanné détecté. Lance l'OCR local si tu veux reconstruire une version lisible.")
        .when(formula_blocks > 0, F.concat(F.lit("PDF importé avec "), formula_blocks.cast("string"), F.lit(" bloc(s) mathématiques. Le mode vérification peut contrôler les formules.")))
        .otherwise("PDF importé localement avec succès.")
    )


def lookup_word(value: Column) -> Column:
    """A word without signs at its ends and with one kind of apostrophe; null counts as empty."""
    return F.translate(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""), "’", "'")


def colouring_tokens(text: Column) -> Column:
    """array<struct<value, type>>: words with one elision and no hyphen; figures count as signs."""
    kind = lambda v: F.when(v.rlike(r"^\s+$"), "space").when(v.rlike(r"\p{L}"), "word").otherwise("punct")
    return F.transform(every(F.coalesce(text, F.lit("")), COLOURING_TOKEN), lambda v: F.struct(v.alias("value"), kind(v).alias("type")))


def dictionary_stats(index: DataFrame) -> DataFrame:
    """Keys and entries of a dictionary index (see words.dictionary_index) by category; null is a category of its own."""
    return index.groupBy("category").agg(F.count(F.lit(1)).alias("n_keys"), F.count_distinct("lemma").alias("n_entries"))
