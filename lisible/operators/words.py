"""Word operators: vocabulary first, then join back; lexicon and dictionary look-ups; repair of damaged text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import syllables as Y
from ..functions.repair import Repairer
from ..functions.text import every, normalise_word

WORDS = r"\p{L}+(?:['’-]\p{L}+)*"
# Endings of a regular verb in -er.
VERB_ENDINGS = ("e", "es", "ent", "ons", "ez", "ais", "ait", "aient", "é", "ée", "és", "ées", "ant")


def vocabulary(df: DataFrame, text_col: str = "text", pattern: str = WORDS) -> DataFrame:
    """Distinct words and their counts, pre-aggregated before the shuffle."""
    return df.select(F.explode(every(F.col(text_col), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def syllables(words: DataFrame, word_col: str = "word", mode: str = "pedagogique") -> DataFrame:
    """words and syllables array<string>, silent_ending, text with hyphens; meant for distinct words."""

    @F.pandas_udf("struct<syllables:array<string>,silent_ending:string,text:string>")
    def cut(values: pd.Series) -> pd.DataFrame:
        found = [Y.analyse(v or "", mode) for v in values]
        return pd.DataFrame({"syllables": [list(p) for p, _ in found], "silent_ending": [e for _, e in found], "text": [Y.syllabify(v or "", "-", mode) for v in values]})

    return words.withColumn("cut", cut(F.col(word_col))).select(*words.columns, "cut.*")


def syllabified_html(df: DataFrame, html_col: str, separator: str = "-") -> DataFrame:
    @F.pandas_udf("string")
    def change(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else Y.syllabify_html(v, separator))

    return df.withColumn(html_col, change(F.col(html_col)))


def variants(key):
    """The word, without s (five letters or more), without es (six or more)."""
    return F.array_distinct(F.array_compact(F.array(key, F.when(key.endswith("s") & (F.length(key) >= 5), F.left(key, F.length(key) - 1)), F.when(key.endswith("es") & (F.length(key) >= 6), F.left(key, F.length(key) - 2)))))


def known_words(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """words and known: a variant is in the lexicon, or every longer part at apostrophes and hyphens is."""
    keyed = words.withColumn("key", normalise_word(F.col(word_col)))
    lex = lexicon.select(F.col(lexicon.columns[0]).alias("lex"))
    whole = keyed.select(word_col, F.explode(variants(F.col("key"))).alias("form")).join(lex, F.col("form") == F.col("lex"), "left_semi").select(F.col(word_col).alias("w")).distinct()
    parts = F.filter(F.split(F.col("key"), "['-]"), lambda p: p != "")
    compound = keyed.where(F.col("key").rlike("['-]") & (F.size(parts) > 1)).select(word_col, F.explode(parts).alias("part"))
    joined = compound.join(lex, F.col("part") == F.col("lex"), "left").groupBy(word_col).agg(F.every((F.length("part") <= 1) | F.col("lex").isNotNull()).alias("ok")).where("ok").select(F.col(word_col).alias("w"))
    found = whole.union(joined).distinct().withColumn("known", F.lit(True))
    return words.join(found, F.col(word_col) == F.col("w"), "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("w")


def lexical_quality(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: considered and known words, their ratio and the review level without merged words."""
    counts = df.select(id_col, F.explode(every(F.col(text_col), WORDS)).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    key = normalise_word(F.col("word"))
    counted = counts.where((F.length(key) >= 4) & ~((F.col("word") == F.upper("word")) & (F.length(key) <= 5)))
    known = known_words(counted.select("word").distinct(), lexicon)
    out = counted.join(known, "word").groupBy(id_col).agg(F.sum("n").alias("considered"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known_words"))
    ratio = F.col("known_words") / F.col("considered")
    out = out.withColumn("known_ratio", ratio)
    doubtful = (F.col("considered") >= 4) & (F.col("considered") - F.col("known_words") >= 2) & (ratio < 0.72) | (F.col("considered") >= 6) & (ratio < 0.5)
    return out.withColumn("review", F.when(~doubtful, "none").when(ratio < 0.5, "medium").otherwise("low"))


def merged_candidates(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """word, left, right: unknown words of 8 to 28 letters that two known words make up, the most even split."""
    lex = lexicon.select(F.col(lexicon.columns[0]).alias("lex"))
    unknown = known_words(words.where(F.length(normalise_word(F.col(word_col))).between(8, 28) & ~normalise_word(F.col(word_col)).rlike("['-]")), lexicon, word_col).where("NOT known")
    keyed = unknown.select(word_col, normalise_word(F.col(word_col)).alias("key"))
    cut = keyed.select(word_col, "key", F.explode(F.sequence(F.lit(3), F.length("key") - 3)).alias("i"))
    cut = cut.select(word_col, F.left("key", F.col("i")).alias("left"), F.substr("key", F.col("i") + 1).alias("right"))
    both = cut.join(lex, F.col("left") == F.col("lex"), "left_semi").join(lex, F.col("right") == F.col("lex"), "left_semi")
    best = F.min_by(F.struct("left", "right"), F.struct(F.abs(F.length("left") - F.length("right")), F.length("left")))
    return both.groupBy(word_col).agg(best.alias("b")).select(word_col, "b.left", "b.right")


def repaired(df: DataFrame, lexicon: DataFrame, text_col: str = "text", max_words: int = 2_000_000) -> DataFrame:
    """df with text_col repaired: exploded, merged, split and apostrophe-glued words, then artifacts.

    The lexicon is a word list of bounded size that every worker holds; a larger one than max_words is refused.
    """
    words = [r[0] for r in lexicon.limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"the lexicon has over {max_words} words")
    shared = df.sparkSession.sparkContext.broadcast(frozenset(words))

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Repairer(shared.value)
        for values in batches:
            yield values.map(lambda v: None if v is None else own.repair(v))

    return df.withColumn(text_col, fix(F.col(text_col)))


def dictionary_index(seeds: DataFrame) -> DataFrame:
    """key, lemma, definition, category: every form of every entry, the first entry of a key wins.

    seeds: seq, lemma, definition, category, variants, auto_plural, auto_feminine, feminine_form, variant_strategy.
    """
    lemma = F.col("lemma")
    plural = lambda w: F.when(w.rlike("[sxz]$"), w).when(w.endswith("eau") | w.rlike("[ae]u$"), F.concat(w, F.lit("x"))).when(w.endswith("al"), F.concat(F.left(w, F.length(w) - 2), F.lit("aux"))).otherwise(F.concat(w, F.lit("s")))
    feminine = F.coalesce("feminine_form", F.concat(lemma, F.lit("e")))
    nominal = F.array(lemma, F.when(F.col("auto_plural"), plural(lemma)), F.when(F.col("auto_feminine"), feminine), F.when(F.col("auto_feminine"), plural(feminine)))
    stem = F.left(lemma, F.length(lemma) - 2)
    verb = F.transform(F.array(*map(F.lit, VERB_ENDINGS)), lambda e: F.concat(stem, e))
    forms = F.when((F.col("variant_strategy") == "er") & lemma.endswith("er"), F.concat(F.array(lemma), verb)).when(F.col("variant_strategy") == "er", F.array(lemma)).when(F.col("variant_strategy") == "custom", F.array(lemma)).otherwise(nominal)
    own = F.array_distinct(F.array_compact(F.concat(forms, F.coalesce("variants", F.array().cast("array<string>")))))
    each = seeds.select("seq", "lemma", "definition", "category", F.posexplode(own).alias("pos", "form")).withColumn("key", normalise_word(F.col("form")))
    first = F.min_by(F.struct("lemma", "definition", "category"), F.struct("seq", "pos"))
    return each.groupBy("key").agg(first.alias("e")).select("key", "e.*")


def dictionary_lookup(words: DataFrame, index: DataFrame, word_col: str = "word") -> DataFrame:
    """words and lemma, definition, category of the first candidate form that the index has."""
    key = normalise_word(F.col(word_col))
    short = lambda n: F.left(key, F.length(key) - n)
    long = F.length(key) >= 5
    forms = F.array_compact(F.array(key, F.when(key.endswith("s") & long, short(1)), F.when(key.endswith("es") & (F.length(key) >= 6), short(2)), F.when(key.endswith("x") & long, F.concat(short(1), F.lit("u"))), F.when(key.endswith("x") & long, short(1))))
    each = words.select(word_col, F.posexplode(forms).alias("pos", "form")).distinct()
    found = each.join(index, F.col("form") == F.col("key")).groupBy(word_col).agg(F.min_by(F.struct("lemma", "definition", "category"), "pos").alias("e")).select(F.col(word_col).alias("w"), "e.*")
    return words.join(found, F.col(word_col) == F.col("w"), "left").drop("w")


def positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, i, word: words of a text in order."""
    return df.select(id_col, F.posexplode(every(F.col(text_col), WORDS)).alias("i", "word"))


def alternation(df: DataFrame, keys: list[str], order_col: str, top_col: str, step: float = 6.0) -> DataFrame:
    """Parity of the visual line: a new line where the top moves by more than `step`."""
    order = Window.partitionBy(*keys).orderBy(order_col)
    new = (F.abs(F.col(top_col) - F.lag(top_col).over(order)) > step).cast("int")
    return df.withColumn("line_parity", F.sum(F.coalesce(new, F.lit(0))).over(order) % 2)
