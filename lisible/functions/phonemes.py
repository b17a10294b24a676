"""Graphemes and phonemes: fixed dimension rows and their column forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import strip_marks

# Phonemes by family; token of a phoneme that is no plain letter; grapheme, phoneme:frequency pairs.
FAMILIES = {
    "voyelles_simples": "a e i o u y E O 2 9 °", "voyelles_nasales": "@ § 5 1", "semi_voyelles": "j w 8 wa", "consonnes_occlusives": "p b t d k g kw k8",
    "consonnes_fricatives": "f v s z S Z ks", "consonnes_liquides": "l R", "consonnes_nasales": "m n N G", "groupes_complexes": "ij On an in", "lettres_muettes": "# %",
}
TOKENS = {
    "#": "silent", "%": "silent-e", "@": "nasal-a", "§": "nasal-o", "5": "nasal-e", "1": "nasal-eu", "°": "schwa", "2": "eu-closed", "9": "eu-open", "8": "semi-ui", "S": "ch", "Z": "j",
    "R": "r", "N": "gn", "G": "ng", "wa": "oi", "ks": "x-ks", "kw": "qu-w", "k8": "qu-ui", "ij": "ill-double", "On": "on-open", "an": "a-open", "in": "i-open",
}
GRAPHEMES = """
a a:6936 #:3
à a:8
â a:154
b b:2220
c k:2891 s:1051
ch S:885 k:46
d d:2580 #:175
e °:5324 %:1574 E:1407 #:506
é e:4045
è E:407
ê E:132
eau o:128
eaux o:64
eu 9:617 2:373
en @:1784 5:115
em @:164
er e:2235
et E:189
f f:1397
ff f:218
g g:966 Z:942
gn N:202
gu g:160
h #:461
i i:5761 j:1858 ij:100
il ij:64
ill j:198 ij:159
im 5:131
in 5:712 in:3
j Z:258
k k:93
l l:4329
ll l:317
m m:3245
mm m:207
n n:2065
nn n:372
o O:3496 o:396
oi wa:427
om §:196
on §:1531 On:7
ou u:1207 w:90
p p:3041
ph f:177
pp p:149
qu k:811 kw:16 k8:2
r R:9147
rr R:302
s s:2488 z:1033 #:359
ss s:850
t t:5306 #:1858 s:568
th t:110
tt t:410
u y:1897 8:306
un 1:16
v v:1579
x #:267 ks:211 z:7 s:5
y i:217
z z:100
ç s:58
aim 5:84
ain 5:98
am @:113
an @:1321 an:9
au o:358 O:19
e[cc] E:645 e:109
ei E:44
ein 5:55
oeu 9:42
"""
LEAST_FREQUENCY = 5

ROWS = [(g, p, int(n), at) for g, *pairs in (line.split() for line in GRAPHEMES.strip().splitlines()) for at, (p, n) in enumerate(x.rsplit(":", 1) for x in pairs)]
KIND = {"voyelles_simples": "vowel", "voyelles_nasales": "nasal", "semi_voyelles": "semivowel", "lettres_muettes": "silent"}
CLASS_OF = {p: KIND.get(f, "consonant") for f, ps in FAMILIES.items() for p in ps.split()}
FIRST = {g: p for g, p, _, at in ROWS if at == 0}


def known_graphemes(least: int = LEAST_FREQUENCY) -> list[str]:
    """Graphemes frequent enough, longest first, then most frequent."""
    best: dict[str, int] = {}
    for g, _, n, _ in ROWS:
        best[g] = max(best.get(g, 0), n)
    return sorted((g for g, n in best.items() if n >= least), key=lambda g: (-len(g), -best[g]))


#: Longest first, so an ordered alternation is the greedy segmentation.
UNITS = "|".join([g.replace("[", r"\[").replace("]", r"\]") for g in known_graphemes()] + ["."])


def dimension(spark: SparkSession) -> DataFrame:
    """grapheme, phoneme, frequency, at (order in the grapheme): some hundred rows."""
    return spark.createDataFrame(ROWS, "grapheme string, phoneme string, frequency int, at int")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, f, CLASS_OF[p], TOKENS.get(p, p.lower())) for f, ps in FAMILIES.items() for p in ps.split()], "phoneme string, family string, class string, token string")


def catalog(spark: SparkSession) -> DataFrame:
    """Each phoneme with its graphemes, most frequent first."""
    own = families(spark).join(F.broadcast(dimension(spark)), "phoneme", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("grapheme").isNotNull(), F.struct((-F.col("frequency")).alias("f"), "grapheme"))))
    return own.groupBy("phoneme", "family", "class", "token").agg(F.array_join(F.transform(pairs, lambda x: x["grapheme"]), " ").alias("graphemes"))


def segment(word: Column) -> Column:
    return F.regexp_extract_all(F.lower(word), F.lit(f"(?s){UNITS}"), F.lit(0))


def resolve(unit: Column, word: Column, at: Column) -> Column:
    """The phoneme of a unit that starts at a place of a word; null for signs that are no grapheme."""
    low = F.lower(word)
    after, before = F.substr(low, at + 2, F.lit(1)), F.when(at > 0, F.substr(low, at, F.lit(1))).otherwise("")
    front, vowel = "[eéiîïyèêë]", "[aeiouyàâäéèêëîïôöùûüÿœæ]"
    table = F.create_map(*(F.lit(x) for pair in FIRST.items() for x in pair))
    return (
        F.when(unit == "c", F.when(after.rlike(front), "s").otherwise("k")).when(unit == "g", F.when(after.rlike(front), "Z").otherwise("g")).when(unit == "s", F.when(before.rlike(vowel) & after.rlike(vowel), "z").otherwise("s"))
        .when(unit == "x", F.when(at == F.length(low) - 1, "#").otherwise("ks")).otherwise(F.element_at(table, unit))
    )


def classify(phoneme: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CLASS_OF.items() for x in pair))
    return F.coalesce(F.element_at(table, phoneme), F.lit("consonant"))


def parity_class(unit: Column) -> Column:
    total = F.aggregate(F.transform(F.split(strip_marks(unit), ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.when(total % 2 == 0, "syllabe1").otherwise("syllabe2")


def units(words: DataFrame, word_col: str = "word") -> DataFrame:
    """word, unit_index, unit, at, phoneme, class for distinct words."""
    cut = words.select(word_col, F.posexplode(segment(F.col(word_col))).alias("unit_index", "unit"))
    before = Window.partitionBy(word_col).orderBy("unit_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("unit")).over(before), F.lit(0)).cast("int"))
    found = placed.withColumn("phoneme", resolve(F.col("unit"), F.col(word_col), F.col("at")))
    return found.withColumn("class", classify(F.col("phoneme")))
