"""Requests to a text model, built only: prompts, limits and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse


def clean(value: Column, most: int = 700, keep_lines: bool = False) -> Column:
    """Model output without fences, leading signs and prefixes, clipped."""
    out = F.regexp_replace(value, "```[a-zA-Z]*", "")
    out = F.regexp_replace(out, r"(?im)^\s*(?:[-*•#>]+|(?:réponse|résumé|définition|reformulation|answer)\s*:)\s*", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), r"\n{3,}", "\n\n")) if keep_lines else collapse(out)
    return F.left(out, F.lit(max(80, most)))


def level(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)) == "lycee", "lycee").otherwise("college")


def request(df: DataFrame, kind: str, text: Column, system: str, lines: list[Column], most: int) -> DataFrame:
    """df with system, prompt, max_length and cache_key; lines that are null are left out."""
    prompt = F.array_join(F.array_compact(F.array(*lines, text)), "\n")
    return df.withColumns({"system": F.lit(system), "prompt": prompt, "max_length": F.lit(most), "cache_key": F.concat_ws(":", F.lit(kind), F.lower(F.left(collapse(text), F.lit(240))))})


def summary(df: DataFrame, text: Column, school_level: str) -> DataFrame:
    return request(df, f"summary-{school_level}", text, "Tu aides à lire.", [F.lit(f"Résume ce texte pour un élève de {'lycée' if school_level == 'lycee' else 'collège'}, en deux phrases courtes.")], 420)


def reformulation(df: DataFrame, text: Column, school_level: str) -> DataFrame:
    return request(df, f"reformulation-{school_level}", text, "Tu aides à lire.", [F.lit(f"Reformule ce texte plus simplement, niveau {'lycée' if school_level == 'lycee' else 'collège'}, sans rien ajouter.")], 520)


def definition(df: DataFrame, word: Column, context: Column) -> DataFrame:
    return request(df, "definition", word, "Tu expliques des mots.", [F.lit("Définis ce mot en une phrase courte."), F.when(context != "", F.concat(F.lit("Contexte : "), F.left(context, F.lit(260))))], 220)


def instructions(df: DataFrame, text: Column, tasks: Column) -> DataFrame:
    listed = F.array_join(F.transform(F.slice(tasks, 1, 8), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    return request(df, "instruction", text, "Tu expliques des consignes.", [F.lit("Reformule la consigne en étapes."), F.when(listed != "", listed)], 520)


def question(df: DataFrame, asked: Column, selected: Column, context: Column) -> DataFrame:
    return request(df, "question", asked, "Tu réponds avec le document seulement.", [F.concat(F.lit("Passage : "), F.left(selected, F.lit(1200))), F.concat(F.lit("Document : "), F.left(context, F.lit(5200)))], 700)
