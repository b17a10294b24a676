"""Queries do the whole job: all questions, all pages, all words."""

import random
from functools import cmp_to_key

import pandas as pd
from pyspark.sql.functions import lit

import __spark_entry__ as entry
from lisible.functions import math as M
from lisible.operators import layout as L
from lisible.operators import retrieval as Q
from lisible.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_every_document_meets_every_question(spark):
    texts = {(d, b): f"Le {('chat', 'chien', 'cheval')[(d + b) % 3]} et la maisonnette {d}" for d in range(50) for b in range(3)}
    asked = {0: "Quel chat ?", 41: "Le chien dans la maison ?", 77: "avec"}
    blocks = spark.createDataFrame([(d, b, 1, t) for (d, b), t in texts.items()], "doc_id long, block int, page int, text string")
    got = Q.corpus_scores(blocks, spark.createDataFrame([*asked.items()], "item_id long, question string"), "item_id").collect()
    words = {0: ["chat"], 41: ["chien", "maison"]}
    want = {(d, b, i): n for (d, b), t in texts.items() for i, ws in words.items() if (n := sum(w in t for w in ws))}
    assert {(r.doc_id, r.block, r.item_id): r.score for r in got} == want and len(got) == len(want)


def test_layout_blocks_covers_all_pages(spark):
    pages = catalog.own_blocks(spark, FOLDER).where("trim(text) <> ''").selectExpr("cast(doc_id as string) AS doc_id", "page").distinct()
    got = entry.queries()["layout_blocks"](spark, FOLDER).selectExpr("doc_id", "page_number AS page").distinct()
    assert pages.where("page > 1").count() > 0 and pages.exceptAll(got).count() == 0


def test_words_of_documents_are_looked_up(spark, tmp_path):
    spark.createDataFrame([(1, "Molécules molécule et animaux"), (2, "molécule"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["dictionary_lookup_documents"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("Molécules", 1, "molécule"), ("molécule", 2, "molécule"), ("et", 1, None), ("animaux", 1, "animal")}


def test_units_make_formulas_of_a_layout(spark):
    counts = {"vitesse 12 km": 1, "3 m": 1, "il a dit": 0, "l'a 3": 0, "la pression 20 Pa et 5 °C": 2, "5 kg 3 min": 2, "12 kmx": 0, "m": 0, "cm²": 1, "": 0}
    assert {t: M.count_units(t) for t in counts} == counts
    words = [("d", 1, i, w, i * 60.0, 700.0, 12.0, 56.0, 800.0) for i, w in enumerate("vitesse de 12 km".split())]
    items = spark.createDataFrame(words, "doc_id string, page_number int, item_seq int, str string, x double, y double, font_size double, width double, page_height double")
    assert [r.type for r in L.blocks(items).collect()] == ["formula"]


ITEM = "doc_id string, page_number int, item_seq int, str string, x double, y double, font_size double, width double, page_height double"


def test_layout_takes_pages_many_at_a_time(spark):
    """Pages, aligned or not, give what the rule gives page by page, and no page is a Python group of its own."""
    rnd = random.Random(4)
    pages = [
        [(f"d{p % 9}", p, i, rnd.choice(["mot", "=", "12", "(", "", "deux mots"]), rnd.choice([0.0, 1.0, 60.0, 61.0, 240.0]), 700 - rnd.choice([0.0, 0.3, 16.0, 40.1] if p % 2 else [0.0, 16.0, 32.0]), rnd.choice([12.0, 18.0, 0.0]), rnd.choice([None, 56.0]), 800.0) for i in range(rnd.randint(1, 9))]
        for p in range(200)
    ]
    items = spark.createDataFrame([r for p in pages for r in p], ITEM)
    want = {}
    for p in pages:
        frame = pd.DataFrame(p, columns=[c.split()[0] for c in ITEM.split(", ")]).astype({"width": float})
        want |= {(p[0][0], p[0][1], i): (line.y, line.height, line.cells(), len(line.parts)) for i, line in enumerate(L.page_lines(frame))}
    for rows in (L.lines(items.repartition(3)), L.lines(items.coalesce(1), together=True)):
        got = rows.collect()
        assert {(r.doc_id, r.page_number, r.line_index): (r.y, r.height, r.cells, r.n_items) for r in got} == want and len(got) == len(want)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_layout_of_documents_shuffles_no_items_and_keeps_repeated_ids_apart(spark, tmp_path):
    texts = [(1, "a b c\nd e"), (1, "f\ng h"), (None, "i j"), (None, "k"), (2, " ".join(["w"] * 10_003) + "\nx y"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    lines = entry.queries()["layout_lines"](spark, str(tmp_path))
    got = sorted((r.doc_id or "", r.page_number, r.line_index, r.n_items) for r in lines.collect())
    assert got == sorted([("1", 1, 0, 3), ("1", 1, 1, 2), ("1", 1, 0, 1), ("1", 1, 1, 2), ("", 1, 0, 2), ("", 1, 0, 1), ("2", 1, 0, 10_003), ("2", 1, 1, 2)])


def test_layout_blocks_fold_in_the_order_of_lines(spark):
    """Lines without signs are not measured; a page's blocks are those of its lines, across batches of any size."""
    rows = [(f"d{p}", 1, 10 * j + i, w, 7.0 * len(" ".join(t.split()[:i] + [""])), 700.0 - 16 * j, 12.0, 7.0 * len(w), 800.0) for p in range(60) for j, t in enumerate(("un mot seul", "et la suite.", "x = 3 y + 2", "- un point", f"fin {p}")) for i, w in enumerate(t.split())]
    found = L.blocks(spark.createDataFrame(rows, ITEM).repartition(7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, {})[r.block_index] = (r.type, r.text)
    for p in range(60):
        assert got[f"d{p}"] == {0: ("paragraph", "un mot seul et la suite."), 1: ("formula", "x = 3 y + 2"), 2: ("list", "- un point"), 3: ("paragraph", f"fin {p}")}


def test_reading_order_takes_pages_many_at_a_time(spark):
    rnd = random.Random(5)
    pages = [[(f"d{p % 7}", p, i, 0, rnd.choice([f"t{i}", " ", f"t{i}"]), x := float(rnd.randint(0, 9) * 20), y := float(rnd.choice([0, 9, 18, 40, 80])), x + 5, y + 5, 80.0, 600, 800) for i in range(rnd.randint(1, 8))] for p in range(150)]
    near = cmp_to_key(lambda a, b: a[6] - b[6] if abs(a[6] - b[6]) > 14 else a[5] - b[5])
    want = {(p[0][1], i): r[4] for p in pages for i, r in enumerate(sorted((r for r in p if r[4] != " "), key=near))}
    schema = "doc_id string, page_number int, block_seq int, par_seq int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, page_width int, page_height int"
    rows = spark.createDataFrame([r for p in pages for r in p], schema)
    for found in (L.ocr_blocks(rows.repartition(3)), L.ocr_blocks(rows.coalesce(1), together=True)):
        got = found.collect()
        assert {(r.page_number, r.block_index): r.text for r in got} == want and len(got) == len(want)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_looked_through_once_for_all_questions(spark):
    """Keywords anywhere in a text, marks aside; repeated rows stay apart; no shuffle, join or look-up a keyword."""
    asked = spark.createDataFrame([(3, "L'élève et la forêt, forêt ?"), (5, "des arbres"), (5, "un œuf vert"), (7, None), (9, "eleve")], "item_id long, question string")
    texts = [(1, 0, 1, "Les ÉLÈVES vont (déforêté) !"), (1, 0, 1, "Les ÉLÈVES vont (déforêté) !"), (2, 0, 1, "arbre, vertś et x"), (2, 1, 1, "élève-arbresœuf"), (3, 0, 1, None), (None, 0, 1, "neuf eleves ici")]
    blocks = spark.createDataFrame(texts, "doc_id long, block int, page int, text string")
    rows = Q.corpus_scores(blocks, asked, "item_id")
    got = sorted((r.doc_id or 0, r.block, r.item_id, r.score) for r in rows.collect())
    assert got == sorted([(1, 0, 3, 2), (1, 0, 3, 2), (1, 0, 9, 1), (1, 0, 9, 1), (2, 0, 5, 1), (2, 1, 3, 1), (2, 1, 5, 1), (2, 1, 9, 1), (0, 0, 3, 1), (0, 0, 9, 1)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert Q.corpus_scores(blocks, asked.limit(0), "item_id").count() == 0


def test_contexts_of_the_best_item_take_one_shuffle(spark):
    found = entry.queries()["question_context_budget"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_every_document_has_a_context_for_every_question(spark):
    """Contexts of all pairs, matched or not, by the rule itself; documents go on from one batch to the next."""
    rnd = random.Random(6)
    asked = {3: ["chat", "chien"], 5: ["cheval"], 7: [], None: ["chien"], 9: ["absent"]}
    questions = spark.createDataFrame([(q, " ".join(words)) for q, words in asked.items()], "item_id long, question string")
    blocks = [(d, b, b // 5 + 1, " ".join(rnd.choices(["chat", "chien", "cheval", "un", "mots"], [1, 1, 1, 5, 9], k=rnd.choice([2, 9, 60, 150])) + ["bref."])) for d in (1, 2, 3, None) for b in range({1: 9, 2: 60, 3: 1, None: 5000}[d])]
    blocks += [(4, 0, 1, "court")] + [(8, b, 1 + b // 5, f"ligne {b} du chat" if b % 3 else f"bloc {b} sans rien") for b in range(70)] + [(6, 0, 1, "x" * 5300), (6, 1, 1, "chat " * 3)]
    rows = spark.createDataFrame(blocks, "doc_id long, block int, page int, text string")

    def context(own, words, at):
        own = [(b, p, t.strip()) for _, b, p, t in sorted(own, key=lambda r: r[1]) if len(t.strip()) >= 8]
        score = {b: sum(w in t for w in words) for b, _, t in own}
        best = sorted((r for r in own if score[r[0]] > 0), key=lambda r: (-score[r[0]], r[1], r[0]))[:10]
        out = ""
        for _, p, t in dict.fromkeys([*own[max(0, at - 4) : at + 7], *best, *own[:8]]):
            chunk, sep = f"[p.{p}] {t}", "\n\n" if out else ""
            if len(out + sep + chunk) > 5200:
                room = 5200 - len(out + sep)
                return out + sep + chunk[:room].rsplit(" ", 1)[0].strip() + "..." if room > 180 else out
            out += sep + chunk
        return out

    documents = {d: [r for r in blocks if r[0] == d] for d, *_ in blocks if d != 4}
    whole = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, at in (("7", None), ("10000", None), ("7", 20)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [tuple(r) for r in Q.contexts(rows, questions, "doc_id", "item_id", None if at is None else lit(at)).collect()]
            want = {(d, q): context(own, words, at or 0) for d, own in documents.items() for q, words in asked.items()}
            assert {(d, q): c for d, q, c in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", whole)


def test_a_context_is_built_for_all_items_of_the_query(spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id")
    documents = Q.readable(catalog.own_blocks(spark, FOLDER)).select("doc_id").distinct()
    got = entry.queries()["question_context_budget"](spark, FOLDER).select("doc_id", "item_id")
    assert items.count() > 1 and got.count() == documents.count() * items.count()
    assert documents.crossJoin(items).exceptAll(got).count() == 0
