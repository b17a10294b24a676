"""Profiles saved and deleted by user, and preferences brought to known values."""

from pyspark.sql import functions as F

from lisible.operators import state as A

COLUMNS = "user string, id string, label string, seq int"


def test_a_save_replaces_its_id_its_label_and_the_draft(spark):
    custom = spark.createDataFrame([("u", "a", "A", 0), ("u", "draft", "D", 1), ("u", "b", "New", 2), ("u", "c", None, 3), ("v", "draft", "D", 0)], COLUMNS)
    saved = spark.createDataFrame([("u", "a", "New", 0)], COLUMNS)
    got = {(r.user, r.id, r.label, r.seq) for r in A.save_profiles(custom, saved, "draft").collect()}
    assert got == {("u", "a", "New", 0), ("u", "c", None, 1), ("v", "draft", "D", 0)}
    assert A.save_profiles(custom, saved.limit(0), "draft").count() == 5 and A.save_profiles(custom.limit(0), saved, "draft").count() == 1
    assert A.delete_profiles(custom, custom.where("id = 'draft' AND user = 'u'").select("user", "id")).count() == 4


def test_names_and_values(spark):
    ids = spark.createDataFrame([("Été à Paris !",), ("--",), (None,)], "label string").select(A.profile_id(F.col("label"), F.lit(7))).collect()
    assert [r[0] for r in ids] == ["custom-ete-a-paris", "custom-7", "custom-7"]
    themes = spark.createDataFrame([(" blanc ",), ("nuitDouce",), ("brume",), ("x",), (None,)], "t string").select(A.theme(F.col("t"), "clair")).collect()
    assert [r[0] for r in themes] == ["clair", "sombre", "intermediaire", "clair", "clair"]
    rows = [("none", None, 0.2), ("custom", "", 0.9), ("custom", "#000000", -1.0), ("rose", None, 0.1), (None, None, None)]
    got = spark.createDataFrame(rows, "p string, c string, o double").select(A.overlay_colour(F.col("p"), F.col("c")), A.overlay_opacity(F.col("p"), F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("transparent", 0.0), ("#dbeafe", 0.3), ("#000000", 0.0), ("#f7dce5", 0.1), ("transparent", 0.0)]
