import pytest
from pyspark.sql import functions as F

from lisible.functions import math as M
from lisible.functions import phonemes as P
from lisible.functions import text as T
from lisible.operators import blocks as B
from lisible.operators import layout as L
from lisible.operators import reading as R
from lisible.operators import requests as Q
from lisible.operators import retrieval as RT
from lisible.operators import speech as S
from lisible.operators import state as A


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


def test_tokens_cover_the_text(spark):
    got = one(spark, T.tokens(F.col("t")), t="l'école porte-monnaie.")
    assert [(x.type, x.start, x.end) for x in got] == [("word", 0, 7), ("space", 7, 8), ("word", 8, 21), ("punct", 21, 22)]


def test_word_boundary_is_ascii(spark):
    assert one(spark, T.count(F.col("t"), r"\b[a-z]\b"), t="été a b") == 3  # the t of été stands between two letters that are no ASCII
    assert one(spark, T.normalise_word(F.col("t")), t=" Œuvre’s–Naïve ") == "oeuvre's-naive"


@pytest.mark.parametrize(
    ("text", "math", "formula"),
    [("3x^2 + 2x - 5 = 0", True, True), ("ΔT = λ/(ρ·c) + α^2", True, True), ("sin(θ) = 0", True, True), ("FR = Frais réels.", False, False), ("Une phrase tout à fait ordinaire.", False, False), ("100 % à 200 % du tarif de remboursement", False, False), ("Livre II - Fable 3 page 12", False, False)],
)
def test_math_verdicts(spark, text, math, formula):
    row = M.measured(spark.createDataFrame([(text,)], "t string"), F.col("t")).first()
    assert (row.contains_math, row.is_formula) == (math, formula)


def test_balanced(spark):
    texts = {"(a[b]{c})": True, "(a": False, ")(": False, "([)]": False, "": True}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.balanced(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == texts


def test_phonemes_in_context(spark):
    df = spark.createDataFrame([("cil",), ("car",), ("rose",), ("noix",), ("gel",), ("bureau",)], "word string")
    rows = P.units(df).collect()
    heard = {(r.word, r.unit): r.phoneme for r in rows}
    assert heard["cil", "c"] == "s" and heard["car", "c"] == "k" and heard["rose", "s"] == "z" and heard["noix", "x"] == "#" and heard["gel", "g"] == "Z" and heard["bureau", "eau"] == "o"
    assert one(spark, P.classify(F.lit("@"))) == "nasal" and one(spark, P.classify(F.lit("?"))) == "consonant"


def test_summary_and_rewriting(spark):
    text = "Petit. Le gouvernement français prépare notamment une réforme importante. Oui. Cependant les citoyens attendent toujours plusieurs réponses précises!"
    assert one(spark, R.short_summary(F.col("t")), t=text).startswith("Le gouvernement") and "Oui." not in one(spark, R.short_summary(F.col("t")), t=text)
    assert one(spark, R.simplify(F.col("t")), t="Cependant, il permet de lire ; notamment ici") .startswith("mais, il sert à lire. surtout")
    assert one(spark, T.clip(F.col("t"), 10), t="un mot assez long") == "un mot…"


def test_instructions(spark):
    x = one(spark, R.instruction(F.col("t")), t="1. Lis le texte. 2. Souligne les verbes puis explique ton choix.")
    assert x.kind == "instruction" and x.multi_task and x.n_tasks >= 2
    assert one(spark, R.instruction(F.col("t")), t="Le chat dort.").kind == "text"
    assert one(spark, R.breakdown(F.col("t")), t="Calcule la somme.").startswith("Consigne reformulée :\n1. ")


def test_keywords(spark):
    assert one(spark, RT.keywords(F.col("t")), t="Quelle est la réaction des élèves, la réaction ?") == ["reaction", "eleves"]


def test_speech_queue(spark):
    blocks = spark.createDataFrame([("d", 0, "Rien."), ("d", 1, "Un deux trois. Quatre cinq six.")], "doc string, block int, text string")
    rows = S.queue(blocks, ["doc"], "block", "text", (1, 0, 1)).orderBy("sentence_index").collect()
    assert [(r.words, r.first_word) for r in rows] == [("deux trois", 1), ("Quatre cinq six", 0)]
    assert one(spark, S.starts_of(F.col("t")), t="  un, deux") == [2, 6] and one(spark, S.word_at(F.array(F.lit(2), F.lit(6)), F.lit(7))) == 1


def test_state(spark):
    rows = [("d", 0, "1-0", 1, 0, 4, "", "a"), ("d", 1, "1-0", 1, 2, 3, "rose", "a"), ("d", 2, "1-1", 1, 5, 5, "rose", "b"), ("d", 3, "", 1, 0, 2, "rose", "c"), ("d", 4, "1-1", 1, 0, 2, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, seq int, block_key string, page_number int, start int, `end` int, color string, id string")
    got = A.normalise_annotations(df)
    assert sorted((r.seq, r.id, r.color) for r in got.collect()) == [(0, "a", "amber"), (4, "1-1:0-2:amber", "amber")]
    assert sorted(map(tuple, A.normalise_annotations(got).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert one(spark, T.storage_hash(F.col("t")), t="abc") == "00017862"
    assert one(spark, A.hours_minutes_seconds(F.lit(3725))) == "01:02:05" and one(spark, A.exam_minutes(F.lit(60))) == 80
    assert one(spark, A.repair_mojibake(F.col("t")), t="Ã©tÃ©") == "été" and one(spark, A.repair_mojibake(F.col("t")), t="été €") == "été €"


def test_requests(spark):
    assert one(spark, Q.clean(F.col("t")), t="```\nRéponse : oui  non\n```") == "oui non"
    row = Q.summary(spark.createDataFrame([("Un texte.",)], "t string"), F.col("t"), "college").first()
    assert "collège" in row.prompt and row.cache_key == "summary-college:un texte."


def items(*rows):
    return [("d", 1, i, s, float(x), float(y), float(f), None, 800.0) for i, (s, x, y, f) in enumerate(rows)]


SCHEMA = "doc_id string, page_number int, item_seq int, str string, x double, y double, font_size double, width double, page_height double"


def test_layout(spark):
    rows = items(("Titre du", 10, 700, 18), ("chapitre", 90, 700.5, 18), ("Une phrase", 10, 660, 12), ("simple", 75, 661, 12), ("qui continue ici.", 10, 645, 12), ("Nom", 10, 600, 12), ("12", 200, 600, 12), ("34", 400, 600, 12), ("Autre paragraphe", 10, 560, 12), ("de deux mots", 10, 545, 12), ("encore.", 10, 530, 12))
    df = spark.createDataFrame(rows, SCHEMA)
    lines = L.lines(df).orderBy("line_index").collect()
    assert lines[0].text == "Titre du chapitre" and lines[1].text == "Une phrase simple" and list(lines[3].cells) == ["Nom", "12", "34"]
    got = [(r.type, r.text) for r in L.blocks(df).orderBy("block_index").collect()]
    assert got[0] == ("heading", "Titre du chapitre") and got[1] == ("paragraph", "Une phrase simple qui continue ici.") and got[2] == ("table", "Nom | 12 | 34") and got[3][1] == "Autre paragraphe de deux mots encore."
    again = L.blocks(df.repartition(3)).orderBy("block_index").collect()
    assert [(r.type, r.text) for r in again] == got


def test_running_text(spark):
    rows = [("d", p, i, 4, t) for p in (1, 2, 3) for i, t in enumerate([f"CHAPITRE 1", f"Texte {p} de la page.", "milieu", "fin"])]
    pages = spark.createDataFrame(rows, "doc string, page int, block_index int, block_count int, text string")
    keys, kept = B.running_text(pages, "doc", "page")
    assert [(r.band, r.run_key, r.first_page) for r in keys.collect()] == [("top", "chapitre 1", 1)] and kept.where("text = 'CHAPITRE 1'").count() == 1


def test_ocr(spark):
    assert one(spark, L.ocr_text(F.col("t")), t="exem-\nple  de\n\n\n\ntexte ") == "exemple de\n\ntexte"
    rows = [("d", 1, i, 0, t, x, y, x + 10, y + 5, 90.0, 600, 800) for i, (t, x, y) in enumerate([("bas", 0.0, 100.0), ("droite", 300.0, 10.0), ("gauche", 5.0, 18.0)])]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, block_seq int, par_seq int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, page_width int, page_height int")
    assert [r.text for r in L.ocr_blocks(df).orderBy("block_index").collect()] == ["gauche", "droite", "bas"]
    assert one(spark, L.adopt(F.lit("good"), F.lit(False), F.lit(1000), F.lit("ocr"), F.lit(80), F.lit(930))) is True
