"""Reading aids: summaries, rewriting, instructions; block flags for decoding aids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, collapse, count, every, js, js_round, sentences, strip_marks

# Words that carry no content, roots of instruction verbs, markers, phrase rewrites.
STOPWORDS = (
    "a afin alors au aucun aussi autre avec car ce cela ces cet cette dans de des du elle elles en et est il ils je la le les leur leurs mais ne nous on ou par pas pour que qui se ses son sur tu un une vers vos votre vous"
).split()
VERBS = (
    "analyse calcule classe compare complete conclus deduis decris demontre determine developpe donne entoure explique exprime identifie indique justifie lis montre nomme observe precise range redige reformule relie releve repere represente repond resous resume souligne trace trouve verifie"
).split()
CONNECTORS = r"(?i)\b(?:puis|ensuite|apres|après|enfin|et)\b"
EXERCISE = r"(?i)\b(?:exercice|question|consigne|probleme|problème|travail|consignes)\b"
QUESTION = r"(?i)\b(?:pourquoi|comment|quel|quelle|quels|quelles|que)\b"
REWRITES = (
    ("cependant", "mais"), ("néanmoins", "mais"), ("toutefois", "mais"), ("afin de", "pour"), ("au cours de", "pendant"), ("est constitué de", "contient"),
    ("se caractérise par", "se reconnaît par"), ("permet de", "sert à"), ("est nécessaire pour", "aide à"), ("est utilisé pour", "sert à"), ("correspond à", "vaut"),
    ("de manière à", "pour"), ("notamment", "surtout"), ("en effet", "car"), ("par conséquent", "donc"),
)
COLLEGE = (("identifier", "repérer"), ("justifier", "expliquer"), ("démontrer", "montrer"), ("analyser", "observer"))
CONTENT_WORD = r"\b[\p{L}'’-]{3,}\b"


def sentence_score(sentence: Column) -> Column:
    """Content words of three letters or more, and up to eight for length."""
    words = F.filter(every(sentence, CONTENT_WORD), lambda w: ~strip_marks(w).isin(*STOPWORDS))
    return F.size(words) + F.least(F.lit(8), js_round(F.length(sentence) / 28)).cast("int")


def short_summary(text: Column, top: int = 2, most: int = 160) -> Column:
    """The best sentences in their order, each clipped. Per row, without a shuffle: a text's sentences are its own."""
    scored = F.transform(sentences(text), lambda s, i: F.struct((-sentence_score(s)).alias("rank"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(scored), 1, top)
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: clip(x["s"], most)), " ")


def simplify(sentence: Column, most: int = 220) -> Column:
    out = reduce(lambda c, r: F.regexp_replace(c, js(rf"(?i)\b{r[0]}\b"), r[1]), REWRITES, F.trim(sentence))
    out = F.regexp_replace(F.regexp_replace(out, js(r"\s*;\s*"), ". "), js(r"\s*:\s*"), " : ")
    return clip(collapse(out), most)


def simplify_for(sentence: Column, level: str) -> Column:
    out = simplify(sentence)
    if level == "college":
        out = reduce(lambda c, r: F.regexp_replace(c, js(rf"(?i)\b{r[0]}\b"), r[1]), COLLEGE, out)
    return clip(out, 170 if level == "college" else 210)


def school_summary(text: Column, level: str) -> Column:
    short = short_summary(text)
    return short if level == "lycee" else F.trim(F.array_join(F.transform(sentences(short), lambda s: simplify_for(s, level)), " "))


def reformulation(text: Column) -> Column:
    out = F.array_join(F.transform(F.slice(sentences(text), 1, 3), simplify), " ")
    return F.when(out == "", "").otherwise(F.concat(F.lit("En clair : "), out))


def school_reformulation(text: Column, level: str) -> Column:
    return F.trim(F.array_join(F.transform(F.slice(sentences(text), 1, 3 if level == "college" else 4), lambda s: simplify_for(s, level)), " "))


def has_verb(text: Column) -> Column:
    return strip_marks(text).rlike(js(rf"\b(?:{'|'.join(VERBS)})[A-Za-z0-9_]*\b"))


def tasks(text: Column) -> Column:
    """Up to six distinct tasks of an instruction: enumerations, sentences and connectors split it."""
    source = F.trim(F.translate(F.regexp_replace(text, "\r\n?", "\n"), "•▪● ", "--- "))
    for pattern, to in ((r"(?i)(?:^|\n)\s*(?:[0-9]+|[a-z])[).]\s+", "\n"), (r"\s*;\s*", "\n"), (r"\s+(?=-\s+)", "\n"), (r"(?i)\s+(?=(?:[0-9]+|[a-z])[).]\s+)", "\n")):
        source = F.regexp_replace(source, js(pattern), to)
    coarse = F.filter(F.transform(F.split(source, "\n+"), F.trim), lambda x: x != "")
    split = F.flatten(F.transform(coarse, lambda x: F.split(x, js(r"(?<=[.!?])\s+"))))
    fine = F.flatten(F.transform(split, lambda x: F.split(x, js(r"(?i)\b(?:puis|ensuite|apres|après|enfin|et)\b(?=\s+[A-Za-zÀÂÄÉÈÊËÎÏÔÖÙÛÜŸàâäéèêëîïôöùûüÿ])"))))
    clean = F.transform(fine, lambda x: F.trim(F.regexp_replace(collapse(F.regexp_replace(x, js(r"^[\s•·\-–—0-9]+[.)\]-]?\s*"), "")), "^[,:;]+", "")))
    kept = F.filter(clean, lambda x: x != "")
    chosen = F.filter(kept, lambda x: has_verb(x) | x.contains("?") | strip_marks(x).rlike(js(EXERCISE)) | (F.size(kept) == 1))
    return F.slice(F.array_distinct(chosen), 1, 6)


def instruction(text: Column) -> Column:
    """struct of kind, is_question, is_instruction, is_exercise, multi_task, n_tasks, label."""
    source = collapse(text)
    n = F.size(tasks(source))
    question = source.contains("?") | source.rlike(js(QUESTION))
    exercise = strip_marks(source).rlike(js(EXERCISE)) | source.rlike(r"^[0-9]+[).]")
    order = has_verb(source) | exercise | (question & (n > 0))
    multi = (n > 1) | (order & strip_marks(source).rlike(js(CONNECTORS)))
    some = source != ""
    kind = F.when(order & multi, "instruction").when(order & question, "question").when(order, "instruction").when(question, "question").otherwise("text")
    label = F.when(order & multi, F.concat(F.lit("Consigne à "), F.greatest(F.lit(2), n).cast("string"), F.lit(" tâches"))).when(order & question, "Question / consigne").when(order, "Consigne simple").when(question, "Question").otherwise("Paragraphe explicatif")
    return F.struct(
        F.when(some, kind).otherwise("text").alias("kind"), (some & question).alias("is_question"), (some & order).alias("is_instruction"), (some & exercise).alias("is_exercise"),
        (some & multi).alias("multi_task"), F.when(some, n).otherwise(0).alias("n_tasks"), F.when(some, label).otherwise("Aucun passage sélectionné").alias("label"),
    )


def breakdown(text: Column, level: str = "college") -> Column:
    found = instruction(text)
    own = tasks(collapse(text))
    steps = F.transform(F.when(F.size(own) > 0, own).otherwise(F.slice(sentences(text), 1, 2)), lambda t: simplify_for(t, level))
    head = F.when(found["multi_task"], F.concat(F.lit("Consigne repérée : "), F.size(steps).cast("string"), F.lit(" étapes."))).when(found["kind"] == "question", "Question reformulée :").otherwise("Consigne reformulée :")
    listed = F.transform(steps, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    none = F.lit("Ce passage ressemble plutôt à une explication qu'à une consigne. Utilise plutôt le résumé ou la reformulation.")
    return F.when(~(found["is_instruction"] | found["is_question"]), none).otherwise(F.array_join(F.concat(F.array(head), listed), "\n"))


# Marks of administrative and structural blocks.
WORDS = r"\b[\p{L}-]{2,}\b"
CAPITALS = r"^[\p{Lu}-]{2,}$"


def capital_words(text: Column) -> Column:
    return F.size(F.filter(every(text, WORDS), lambda w: w.rlike(CAPITALS)))


def capital_ratio(text: Column) -> Column:
    n = F.size(every(text, WORDS))
    return F.when(n > 0, capital_words(text) / n).otherwise(0.0)


def administrative(text: Column, keyword: str, code: str) -> Column:
    """keyword and code: patterns of administrative words and of addresses or codes."""
    t = F.trim(text)
    k, c, ratio = t.rlike(js(keyword)), t.rlike(js(code)), capital_ratio(t)
    return (k & (c | t.contains("|") | (ratio >= 0.4))) | (c & (ratio >= 0.5)) | t.rlike(js(r"(?:\b[\p{Lu}-]{4,}\b(?:\s+|$)){3,}"))


def structural(text: Column) -> Column:
    """Fixed titles, and at most five words that all begin with a capital or are particles."""
    t = F.trim(text)
    words = every(t, r"\b[\p{L}'’.-]+\b")
    each = F.forall(words, lambda w: F.translate(strip_marks(w), "'’", "").isin("", "de", "du", "des", "la", "le", "les", "et", "d", "l") | w.rlike(r"^\p{Lu}"))
    titled = t.rlike(js(r"(?i)^(?:Sommaire|Cycle\s+[0-9]+|Fables?|Livre\s+[IVXLCDM]+)$"))
    return (t != "") & (titled | (F.size(words).between(1, 5) & ~t.rlike("[,:;!?]") & each))


def flagged(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    return df.withColumns({"capital_words": capital_words(t), "capital_ratio": capital_ratio(t), "structural": structural(t), "n_words": count(t, WORDS)})


# Words and codes of administrative blocks, stopwords of the emphasis rule, coloration modes.
ADMIN_WORDS = r"(?i)\b(?:acad[eé]mie|adresse|adolphe|affectation|arr[eê]t[eé]|avenue|cap|cert(?:ificat)?|collectif|croix|extrait|individuel|isnard|nice|recteur|rectoral|serrat|zone)\b"
ADMIN_CODES = r"\b(?:[0-9]{5}|[0-9]{7}[A-Z]|[0-9]{1,4}[A-Z]{1,3})\b"
PLAIN_STOPWORDS = (
    "a afin ainsi alors au aucun aussi autre avec bien car ce cela ces cet cette chez comme comment dans de des du elle elles en entre est et etre eux ici il ils je la le les leur leurs lui mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sous sur ta te tes toi ton tu un une vers vos votre vous y"
).split()
BACKGROUND_MODES = ("alternanceLignes", "alternanceMots", "noirEtBlanc")
COLORATION_MODES = ("pedagogique", "sonsFrancais", *BACKGROUND_MODES)


def keeps_plain(word: Column, assist_disabled: Column | None = None) -> Column:
    """Words that get no decoding aid: with a figure, in capitals, a capital and at most two small letters."""
    plain = (word == "") | word.rlike("[0-9]") | word.rlike(CAPITALS) | word.rlike(r"^\p{Lu}\p{Ll}{0,2}$")
    return plain if assist_disabled is None else assist_disabled | plain


def important(word: Column, block_type: Column) -> Column:
    key = F.translate(strip_marks(word), "'’", "")
    return ~keeps_plain(word) & (key != "") & ~key.isin(*PLAIN_STOPWORDS) & (((block_type == "heading") & (F.length(key) >= 4)) | word.rlike(r"^\p{Lu}{3,}$") | (F.length(key) >= 8))


def coloration_mode(value: Column) -> Column:
    return F.when(value == "grammar", "pedagogique").when(value == "alternanceMotsNB", "noirEtBlanc").when(value.isin(*COLORATION_MODES), value).otherwise("none")


def word_pattern(mode: Column, word_index: Column) -> Column:
    return F.when(mode.isin(*BACKGROUND_MODES), F.when(word_index % 2 == 0, "a").otherwise("b")).otherwise("")


def definition(word: Column, known: Column, suffixes: tuple[tuple[str, str], ...]) -> Column:
    """A dictionary definition, else the first that a word ending suggests, else null."""
    key = strip_marks(word)
    guess = reduce(lambda rest, s: F.when(key.rlike(f"(?:{s[0]})$"), s[1]).otherwise(rest), reversed(suffixes), F.lit(None).cast("string"))
    return F.coalesce(known, guess)
