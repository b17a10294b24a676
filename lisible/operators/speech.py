"""Reading aloud: sentence queues, word lookup for progress events, durations, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import AUDIO_TOKEN, every, running_sums


def segments(text: Column) -> Column:
    """Sentences for speech: ends at . ! ? ; : before white space or the end, or at a line break."""
    parts = F.split(F.regexp_replace(text, r"([.!?;:]+)(?:\s+|$)|\n+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def words(text: Column) -> Column:
    return every(text, AUDIO_TOKEN)


def queue(blocks: DataFrame, keys: list[str], order_col: str, text_col: str, start: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """keys, order, sentence_index, text, n_words, first_word: items from a start block, sentence and word on.

    The first item loses the words before the start and remembers the original index of its first.
    """
    block, sentence, word = start
    out = blocks.where(F.col(order_col) >= block).select(*keys, order_col, F.posexplode(segments(F.col(text_col))).alias("sentence_index", "text"))
    out = out.where((F.col(order_col) > block) | (F.col("sentence_index") >= sentence))
    first = F.when((F.col(order_col) == block) & (F.col("sentence_index") == sentence), word).otherwise(0)
    all_words = words(F.col("text"))
    own = F.slice(all_words, first + 1, F.size(all_words))
    return out.select(*keys, order_col, "sentence_index", F.array_join(own, " ").alias("words"), F.size(own).alias("n_words"), first.alias("first_word"))


def word_at(starts: Column, char_index: Column) -> Column:
    """The last word that starts at or before a character, 0 before the first; within the row, no join."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= char_index)) - 1, F.lit(0))


def starts_of(text: Column) -> Column:
    """Offsets of the audio words of a text."""
    gaps, found = F.split(text, AUDIO_TOKEN, -1), words(text)
    through = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, w: F.length(g) + F.length(w)))
    return F.zip_with(through, found, lambda end, w: end - F.length(w))


def duration_ms(word: Column, rate: float = 1.0) -> Column:
    factor = F.greatest(F.lit(0.95), F.least(F.lit(1.55), F.length(word) / 7))
    return F.greatest(F.lit(220.0), F.least(F.lit(1350.0), factor * 470.0 / max(rate, 0.35)))


def running_durations(tokens: DataFrame, keys: list[str], order_col: str, word_col: str) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("ms", duration_ms(F.col(word_col))).withColumn("until_ms", F.sum("ms").over(upto))


def changes(events: DataFrame, keys: list[str], order_cols: list[str], value_col: str) -> DataFrame:
    """Events whose value differs from the one before."""
    before = F.lag(value_col).over(Window.partitionBy(*keys).orderBy(*order_cols))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value_col))).drop("before")


def native_rate(rate: Column) -> Column:
    held = F.greatest(F.lit(0.45), F.least(F.lit(2.0), rate))
    return F.greatest(F.lit(-10), F.least(F.lit(10), F.floor((held - 1) * 10 + 0.5).cast("int")))


def preferred_voice(voices: DataFrame, wanted: str | None) -> DataFrame:
    """Exact id, else the first French voice, else the default, else the first."""
    rank = F.when(F.col("voice_id") == F.lit(wanted), 0).when(F.lower("lang").startswith("fr"), 1).when(F.col("is_default"), 2).otherwise(3)
    return voices.agg(F.min_by(F.struct("voice_id", "lang"), F.struct(rank, F.col("seq"))).alias("voice")).select("voice.*")
