"""Keyed state of readers: annotations, recent files, profiles and preferences, manifests and names for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import storage_hash

MAX_ANNOTATIONS, MAX_RECENT = 120, 6


def normalise_annotations(df: DataFrame, doc_col: str = "doc_id", seq_col: str = "seq", limit: int = MAX_ANNOTATIONS) -> DataFrame:
    """Valid entries, defaults filled, first of an id wins, at most `limit` a document in list order."""
    start, end = F.expr("try_cast(start AS double)"), F.expr("try_cast(`end` AS double)")
    ok = df.where(F.col("block_key").isNotNull() & (F.col("block_key") != "") & start.isNotNull() & end.isNotNull() & (end > start))
    color = F.coalesce(F.nullif(F.col("color"), F.lit("")), F.lit("amber"))
    filled = ok.withColumns({"color": color, "id": F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.col("block_key"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), color))})
    first = F.row_number().over(Window.partitionBy(doc_col, "id").orderBy(seq_col))
    place = F.row_number().over(Window.partitionBy(doc_col).orderBy(seq_col))
    return filled.withColumn("nth", first).where("nth = 1").withColumn("place", place).where(F.col("place") <= limit).drop("nth", "place")


def upsert_annotations(entries: DataFrame, news: DataFrame, doc_col: str = "doc_id", limit: int = MAX_ANNOTATIONS) -> DataFrame:
    """New entries go before the old ones, so they win over the same id."""
    both = news.withColumn("age", F.lit(0)).unionByName(entries.withColumn("age", F.lit(1)))
    order = both.withColumn("seq", F.row_number().over(Window.partitionBy(doc_col).orderBy("age", "seq")))
    return normalise_annotations(order.drop("age"), doc_col, "seq", limit)


def remove_annotations(entries: DataFrame, gone: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return normalise_annotations(entries.join(gone, [doc_col, "id"], "left_anti"), doc_col)


def block_annotations(entries: DataFrame, block_key: str) -> DataFrame:
    return entries.where(F.col("block_key") == block_key).orderBy("start", "end")


def overlaps(tokens: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Per token the first overlapping annotation, half-open intervals, by an equi-join on the block."""
    met = tokens.join(entries.select(*keys, F.col("start").alias("a_start"), F.col("end").alias("a_end"), "color"), keys)
    met = met.where((F.col("a_start") < F.col("end")) & (F.col("a_end") > F.col("start")))
    return met.groupBy(*tokens.columns).agg(F.min_by("color", F.struct("a_start", "a_end", "color")).alias("color"))


def annotations_text(entries: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Numbered report of each document's annotations (at most MAX_ANNOTATIONS)."""
    one = F.array_sort(F.collect_list(F.struct("seq", "page_number", "color", "excerpt")))
    rows = F.transform(one, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Page "), F.coalesce(x["page_number"].cast("string"), F.lit("?")), F.lit(" ["), x["color"], F.lit("] "), F.coalesce(x["excerpt"], F.lit(""))))
    return entries.groupBy(doc_col).agg(F.array_join(rows, "\n").alias("report"))


def recent_files(opened: DataFrame, user_col: str, file_col: str, at_col: str, tie_col: str, limit: int = MAX_RECENT) -> DataFrame:
    """A user's newest files, each once: a pre-aggregated maximum, then a rank that keeps `limit` rows a group."""
    last = opened.groupBy(user_col, file_col).agg(F.max(F.struct(at_col, tie_col)).alias("last")).select(user_col, file_col, F.col(f"last.{at_col}").alias(at_col), F.col(f"last.{tie_col}").alias(tie_col))
    order = Window.partitionBy(user_col).orderBy(F.desc(at_col), F.desc(tie_col))
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def overlay(defaults: Column, stored: Column) -> Column:
    """Stored entries over defaults; maps need not be disjoint."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(stored, k)), stored)


def all_profiles(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in profiles and the custom ones that do not reuse an id."""
    return builtin.unionByName(custom.join(builtin, "id", "left_anti"))


def save_profiles(custom: DataFrame, saved: DataFrame, draft_id: str, seq_col: str = "seq") -> DataFrame:
    """Custom profiles after one save a user, newest first: the saved one replaces those of its id or label, and drafts go.

    Columns user, id, label and seq. Null labels equal no other; users without a save keep all; columns of both must agree.
    """
    news = saved.select("user", F.col("id").alias("_saved_id"), F.col("label").alias("_saved_label"))
    replaced = (F.col("id") == F.col("_saved_id")) | F.coalesce(F.col("label") == F.col("_saved_label"), F.lit(False)) | (F.col("id") == draft_id)
    old = custom.join(news, "user", "left").where(F.col("_saved_id").isNull() | ~replaced).select(*custom.columns)
    both = saved.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    return both.withColumn(seq_col, F.row_number().over(Window.partitionBy("user").orderBy("_age", seq_col, "id")) - 1).drop("_age")


def delete_profiles(custom: DataFrame, gone: DataFrame) -> DataFrame:
    """Custom profiles without those of (user, id) in gone."""
    return custom.join(gone, ["user", "id"], "left_anti")


def profile_id(label: Column, otherwise: Column) -> Column:
    """custom- and the label's letters and digits, runs of others as one -; `otherwise` stands in where none are left."""
    from ..functions.text import strip_marks

    slug = F.regexp_replace(F.regexp_replace(strip_marks(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("custom-"), F.coalesce(F.nullif(slug, F.lit("")), otherwise.cast("string")))


# Themes by the names they had, overlay colours.
THEMES = {"clair": "clair", "intermediaire": "intermediaire", "sombre": "sombre", "blanc": "clair", "neutre": "intermediaire", "brume": "intermediaire", "creme": "intermediaire", "contraste": "intermediaire", "nuitDouce": "sombre"}
OVERLAYS = {"none": "transparent", "creme": "#f1e8c9", "blue": "#dbeafe", "green": "#dff3e7", "rose": "#f7dce5", "yellow": "#f5e7a9", "grey": "#e4e7eb"}


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.coalesce(c, F.lit("")))


def theme(c: Column, otherwise: str) -> Column:
    """The theme a name stands for; `otherwise` for null and unknown names."""
    return F.coalesce(_named(F.trim(c), THEMES), F.lit(otherwise))


def overlay_colour(preset: Column, own: Column) -> Column:
    """The preset's colour, the own one of a custom preset; unknown and null presets are transparent."""
    return F.when(preset == "custom", F.coalesce(F.nullif(own, F.lit("")), F.lit(OVERLAYS["blue"]))).otherwise(F.coalesce(_named(preset, OVERLAYS), F.lit(OVERLAYS["none"])))


def overlay_opacity(preset: Column, opacity: Column) -> Column:
    """0 without an overlay, else between 0 and 0.3; null counts as 0."""
    return F.when(preset == "none", F.lit(0.0)).otherwise(clamp(F.coalesce(opacity.cast("double"), F.lit(0.0)), 0.0, 0.3))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def exam_minutes(base: Column) -> Column:
    """Ten minutes at least, and a third more."""
    return F.floor(F.greatest(base, F.lit(10)) * 4 / 3 + 0.5).cast("int")


def hours_minutes_seconds(seconds: Column) -> Column:
    part = lambda e: F.lpad(F.floor(e).cast("string"), 2, "0")
    return F.concat_ws(":", part(seconds / 3600), part(seconds % 3600 / 60), part(seconds % 60))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1 is read again; texts with characters beyond Latin-1, or without the signs, stay."""
    fixed = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(c.rlike("[ÃÂâ]") & ~c.rlike(r"[^\x00-\xFF]"), F.when(F.encode(c, "ISO-8859-1").isNotNull() & F.is_valid_utf8(F.encode(c, "ISO-8859-1").cast("string")), fixed).otherwise(c)).otherwise(c)


def storage_key(path: Column, name: Column, n_pages: Column, n_blocks: Column) -> Column:
    return storage_hash(F.concat_ws("|", path, name, n_pages.cast("string"), n_blocks.cast("string")))


def export_name(title: Column, suffix: str) -> Column:
    """A file name from a title: no accents, other signs than letters, digits, _ and - as one -, trimmed."""
    from ..functions.text import strip_marks

    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip_marks(title), r"\.pdf$", ""), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit(suffix))


def manifest(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: pages with their blocks as JSON, and counts; two nested, ordered aggregates on the same key."""
    pages = own.groupBy(id_col, "page").agg(F.array_sort(F.collect_list(F.struct("block_index", "type", "text"))).alias("blocks"), F.count(F.lit(1)).alias("n"))
    docs = pages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"), F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_pages"))
    return docs.select(id_col, "n_pages", "n_blocks", F.to_json(F.struct(F.col(id_col), "n_pages", "n_blocks", "pages")).alias("manifest"))
