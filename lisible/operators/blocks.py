"""Documents as pages of typed blocks, what is said about them, and page furniture that repeats.

A block is a non-blank line, a page five of them; the layout operators build the same columns from positioned text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions.text import SPACE, collapse, js, lines

PAGE_LINES = 5
CELL = " | "
# Fixed patterns of headings, lists and tables of contents.
LIST = r"^(?:[•\-*]\s+|[0-9]+[.)]\s+|[a-zA-Z][.)]\s+)"
CONTENTS_ENTRY = r"(?i)\bLivre\s+[IVXLCDM]+\s*-\s*Fable\s+[0-9]+\s+page\s+[0-9]+\b"
DECORATIVE = r"(?i)^(?:Cycle\s+[0-9]+|Jean de La Fontaine$|Litt[ée]rature$|FABLE$|Litt[ée]rature(?:\s*\|\s*|\s+)FABLE\b)"
BANNER = r"(?i)^(?:Litt[ée]rature(?:\s*\|\s*|\s+)FABLE\b|FABLE$)"
FURNITURE = r"(?i)^(?:Cycle\s+[0-9]+|Litt[ée]rature(?:\s+FABLE)?|Livre\s+[IVXLCDM]+\s*-\s*Fable\s+[0-9]+)$"


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_lines: int = PAGE_LINES) -> DataFrame:
    """id, block (from 0 in the document), page (from 1), block_index (from 0 in the page), text."""
    out = df.select(F.col(id_col), F.posexplode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("block", "text"))
    return out.select(id_col, "block", (F.floor(F.col("block") / page_lines) + 1).cast("int").alias("page"), (F.col("block") % page_lines).alias("block_index"), "text")


def cells(text: Column) -> Column:
    """Cells of a line; decorative ones go if another is left."""
    own = F.filter(F.transform(F.split(text, r" \| "), collapse), lambda x: x != "")
    rest = F.filter(own, lambda x: ~x.rlike(js(DECORATIVE)))
    return F.when((F.size(own) > 1) & (F.size(rest) > 0), rest).otherwise(own)


def table_like(own: Column, n_items: Column) -> Column:
    """Three cells or more, with figures, a repeated cell, mostly short cells or many items."""
    n = F.size(own)
    short = F.size(F.filter(own, lambda x: F.length(x) <= 28))
    return (n >= 3) & (F.exists(own, lambda x: x.rlike("[0-9%€]")) | (F.size(F.array_distinct(F.transform(own, F.lower))) < n) | (short >= F.greatest(F.lit(2), n - 1)) | (n_items >= n + 2))


def block_type(text: Column, is_formula: Column, is_table: Column, large: Column) -> Column:
    """formula, table, entry of a table of contents, heading (large and short), list, paragraph: first that fits."""
    return (
        F.when(is_formula, "formula").when(is_table, "table").when(collapse(text).rlike(js(CONTENTS_ENTRY)), "paragraph").when(large & (F.length(text) <= 90), "heading").when(text.rlike(js(LIST)), "list").otherwise("paragraph")
    )


def typed(own: DataFrame) -> DataFrame:
    """Blocks with cells, type and the columns of math.measured."""
    out = own.withColumn("cells", cells(F.col("text")))
    out = M.measured(out, F.array_join("cells", ". "))
    out = out.withColumn("is_table", ~F.col("is_formula") & table_like(F.col("cells"), F.size("cells")))
    return out.withColumn("type", block_type(F.col("text"), F.col("is_formula"), F.col("is_table"), F.lit(False)))


def diagnostics(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: blocks, math, formula and table blocks, and pages that have some.

    Counted a page first, so that no row is expanded for the distinct pages. Without blocks a document has no row.
    """
    if_ = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    pages = typed(own).groupBy(id_col, "page").agg(
        F.count(F.lit(1)).alias("n_blocks"), if_(F.col("contains_math")).alias("math_blocks"), if_(F.col("is_formula")).alias("formula_blocks"),
        if_(F.col("type") == "table").alias("table_blocks"), if_(F.col("type") == "list").alias("list_blocks"),
    )
    total = [F.sum(c).alias(c) for c in ("n_blocks", "math_blocks", "formula_blocks", "table_blocks", "list_blocks")]
    return pages.groupBy(id_col).agg(*total, F.count_if(F.col("math_blocks") > 0).alias("math_pages"), F.count_if(F.col("formula_blocks") > 0).alias("formula_pages"))


def page_models(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return own.groupBy(id_col, "page").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("items"))


def quality(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: characters, pages, poor pages and the grade: poor, partial or good."""
    poor = (F.col("chars") < 35) | (F.col("items") < 8)
    out = page_models(own, id_col).groupBy(id_col).agg(F.sum("chars").alias("total_chars"), F.count(F.lit(1)).alias("n_pages"), F.count_if(poor).alias("poor_pages"))
    ratio = F.col("poor_pages") / F.col("n_pages")
    return out.withColumn("quality", F.when((F.col("total_chars") < 180) | (ratio >= 0.8), "poor").when(ratio >= 0.25, "partial").otherwise("good"))


def warnings(quality_col: Column, n_formulas: Column, n_verify: Column, n_tables: Column, total: Column) -> Column:
    """Codes in order: scan or partial, no text, formulas, verification, tables only."""
    found = F.array(
        F.when(quality_col == "poor", "scan").when(quality_col == "partial", "partial"), F.when(total == 0, "no-text"), F.when(n_formulas > 0, "formulas"), F.when(n_verify > 0, "verify"),
        F.when((n_formulas == 0) & (n_verify == 0) & (n_tables > 0), "tables"),
    )
    return F.array_compact(found)


def running_candidate(text: Column) -> Column:
    """Short, no sentence end, and a figure, a Roman numeral, a word in capitals or mostly capitals."""
    t = collapse(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    upper = letters - F.regexp_count(t, F.lit(r"[\p{L}&&[^\p{Lu}\p{Lt}\p{Lo}\p{Lm}]]"))
    mark = t.rlike("[0-9]") | t.rlike(js(r"\b[IVXLCDM]{1,8}\b")) | t.rlike(js(r"\b\p{Lu}{4,}\b")) | ((letters > 0) & (upper / F.greatest(letters, F.lit(1)) >= 0.62))
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(js(CONTENTS_ENTRY)) & ~t.rlike("(?i)^Sommaire$") & ~t.rlike("[.:;!?]$") & mark


def band(block_index: Column, block_count: Column) -> Column:
    """First three blocks of a page, else last two."""
    return F.when(block_index <= 2, "top").when(block_index >= block_count - 2, "bottom")


def running_text(pages: DataFrame, doc_col: str, page_col: str) -> tuple[DataFrame, DataFrame]:
    """Keys (doc, band, lower text) on two pages or more with their first page, and the blocks without later repeats.

    pages: doc, page, block_index, block_count, text. The keys come from a pre-aggregated group-by; the join back is
    on the key, so adaptive execution can broadcast a small side or split a hot key.
    """
    banded = pages.withColumns({"band": band(F.col("block_index"), F.col("block_count")), "run_key": F.lower(collapse(F.col("text")))})
    candidates = banded.where(F.col("band").isNotNull() & running_candidate(F.col("text")))
    keys = candidates.groupBy(doc_col, "band", "run_key").agg(F.min(page_col).alias("first_page"), F.count_distinct(page_col).alias("n_pages")).where("n_pages >= 2")
    kept = banded.join(keys, [doc_col, "band", "run_key"], "left").where(F.col("first_page").isNull() | (F.col(page_col) == F.col("first_page")))
    return keys, kept.select(*pages.columns)


def page_clean(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without banners and page furniture, except on pages that are a table of contents (three entries or more)."""
    t = collapse(F.col("text"))
    entries = F.count_if(t.rlike(js(CONTENTS_ENTRY))).over(Window.partitionBy(id_col, "page"))
    out = own.withColumn("contents_entries", entries)
    return out.where((F.col("contents_entries") >= 3) | ~((t == "") | t.rlike(js(BANNER)) | t.rlike(js(FURNITURE))))


def heading_continues(previous: Column, following: Column, gap: Column, height: Column) -> Column:
    ends = F.trim(previous).rlike("[:.!?]$")
    starts = F.trim(following).rlike("^[a-zàâäéèêëîïôöùûüÿœæç]")
    return ~previous.rlike(js(DECORATIVE)) & ~following.rlike(js(DECORATIVE)) & ~ends & (gap <= height * 2.2) & starts


__all__ = ["SPACE", "band", "block_type", "blocks", "cells", "diagnostics", "heading_continues", "page_clean", "page_models", "quality", "running_candidate", "running_text", "table_like", "typed", "warnings"]
