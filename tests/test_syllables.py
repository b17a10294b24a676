import random

import pytest

from lisible.functions import syllables as Y


@pytest.mark.parametrize(
    ("word", "want"),
    [("numéro", "nu-mé-ro"), ("arrête", "ar-rête"), ("Garantie", "Ga-ran-tie"), ("animal", "an-im-al"), ("sœur", "sœ-ur"), ("été", "é-té"), ("aujourd'hui", "au-jourd'hui"), ("l'école", "l'é-co-le"), ("porte-monnaie", "por-te-mon-naie"), ("parlent", "parlent")],
)
def test_pedagogic(word, want):
    assert Y.syllabify(word) == want


def test_typographic_and_levels():
    assert Y.syllabify("numéro", "-", "typographique") == "numé-ro"
    assert not Y.shown("bonjour", "light") and Y.shown("bonjour", "strong") and not Y.shown("bonjour", "off")


def test_silent_endings():
    for word in ("parlent", "chantent", "grands", "heureux"):
        assert Y.analyse(word)[1]
    for word in ("vent", "moment", "tas", "comment", "bus"):
        assert Y.analyse(word)[1] == ""
    assert Y.analyse("parlent") == (("parl",), "ent")


def test_html_keeps_tags():
    assert Y.syllabify_html("<p>bonjour <strong>moteur</strong> !</p>") == "<p>bon-jour <strong>mo-teur</strong> !</p>"


def test_syllables_join_to_the_word():
    rnd = random.Random(3)
    for _ in range(2000):
        word = "".join(rnd.choice("aeéèiouyœbcdfghlmnprstvx'-") for _ in range(rnd.randint(1, 12)))
        for mode in ("pedagogique", "typographique"):
            parts, ending = Y.analyse(word, mode)
            assert "".join(parts) + ending == word
