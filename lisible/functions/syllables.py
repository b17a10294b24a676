"""French syllables of a word: exceptions, silent endings, vowel graphemes, onsets, two styles.

Pure functions of one word; operators.words applies them to distinct words in Arrow batches and joins back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Exceptions as their syllables; the first list holds for the exact spelling, the second without accents.
EXACT = (
    "au-jourd'hui quel-qu'un ren-con-tré ren-con-trée ren-con-trés ren-con-trées con-cen-tré con-cen-trée con-cen-trés con-cen-trées"
).split()
LOOSE = (
    "ar-rête ré-si-dence nu-mé-ro pa-ri-té spé-cu-ler ga-ran-tie ar-gent ex-pert in-for-mer ad-joint bal-let com-mis-sion ap-pel ta-ble a-bri ci-bler com-plet en-trer dé-bray-er ou-vrir a-che-ter é-lé-phant hy-po-thè-se i-gno-rer al-go-rith-me comp-ter fonc-tion-ner ap-pli-ca-ble as-sem-blée af-flux ag-gra-ver ma-ïs na-ïf ré-u-nion co-o-pé-ra-tive an-ti-a-ci-de par-le lu-ne té-lé-pho-ne a-vec é-té fa-mille fille ville mille bille grille va-nille che-nille che-ville pas-tille co-quille quille feuille paille taille maille a-beille bou-teille o-reille cor-neille gro-seille mer-veille veille vieille so-leil or-teil ap-pa-reil con-seil som-meil ré-veil ac-cueil cer-cueil é-cu-reuil fau-teuil seuil œil mon-sieur femme oi-gnon soi-xante ex-cel-lent ex-trême dé-fin-i-tion com-mun-i-ca-tion do-cum-ent é-lém-ent sim-i-laire con-tient in-ter-vient ex-tra-or-di-naire con-struc-tion ren-contre ren-con-trer ren-con-trait ren-con-traient ren-con-trons ren-con-trez con-cen-tra-tion"
).split()
#: Words whose last letters are not a silent ending.
SOUNDED = frozenset(
    "absent accent accident adolescent agent aliment appartient appartement argent autant avant batiment bus cactus cement cent client comment competent complement confident conscient content continent contient convient courant dent devient different document element eminent enfant enseignant entretient equipement est etudiant evenement evident fervent fondement fragment frequent gent gouvernement habitant huit ignorant important incident independant indulgent innocent instrument intelligent intervient lent logement maintient mais mars mes met moment monument mouvement nord obtient orient ornement ouest ours parent parlement parvient patient permanent placement plus precedent present president pres prudent provient puissant recent regiment restaurant retient revient savant segment sentiment sergent serpent soixante souvent soutient sud supplement survient talent tas temps tient torrent tous transparent tres urgent vent vient violent virus vivant".split()
)
ENDINGS = ("ent", "s", "x", "t", "d")
VOWELS = "eille aille eaux euil ueil eau oeu oin ain ein ion ien ieu oui ui oi ou au eu ai ei ay on an en in un om am em im um".split()
CONSONANTS = ("ch", "ph", "th", "gn", "qu")
PAIRS = frozenset("bl br cl cr dr fl fr gl gr pl pr tr vr".split())
TRIPLES = frozenset(("scr", "spl", "spr", "str"))
ELIDED = frozenset("c d j jusqu l lorsqu m n puisqu qu quoiqu s t".split())
VOWEL_LETTERS = frozenset("aeiouyàâäæéèêëîïôöœùûüÿAEIOUYÀÂÄÆÉÈÊËÎÏÔÖŒÙÛÜŸ")
DIAERESIS = frozenset("ïëüöÿÏËÜÖŸ")
APOSTROPHES = "'’"

MARKS = re.compile("[̀-ͯ]")


def plain(value: str) -> str:
    """Lower case, ligatures spelled out, no accents."""
    return "".join(c for c in unicodedata.normalize("NFD", value.lower()).replace("œ", "oe").replace("æ", "ae") if not "̀" <= c <= "ͯ")


def letters(value: str) -> int:
    return sum(unicodedata.category(c)[0] == "L" for c in value)


def has_vowel(value: str) -> bool:
    return any(c in VOWEL_LETTERS for c in value)


_EXACT = {w.replace("-", ""): w.split("-") for w in EXACT}
_LOOSE = {plain(w.replace("-", "")): w.split("-") for w in LOOSE}


def exception(word: str) -> list[str] | None:
    """The word cut like its exception; None where the lengths do not add up."""
    word = unicodedata.normalize("NFC", word)
    known = _EXACT.get(word.lower()) or _LOOSE.get(plain(word))
    if not known or sum(map(len, known)) < len(word):
        return None
    out, at = [], 0
    for part in known:
        if not word[at : at + len(part)]:
            return None
        out.append(word[at : at + len(part)])
        at += len(part)
    return out if at == len(word) else None


def silent_ending(word: str) -> tuple[str, str]:
    key = plain(word)
    if len(key) > 2 and key not in SOUNDED:
        for ending in ENDINGS:
            fits = key.endswith(ending) and not (ending == "ent" and key.endswith("ment")) and not (len(ending) == 1 and len(key) <= 3)
            if fits and len(word) - len(ending) >= 2:
                return word[: -len(ending)], word[-len(ending) :]
    return word, ""


def units(word: str) -> list[tuple[str, str, bool]]:
    """(text, plain text, is vowel): longest vowel groups, then consonant pairs, then letters."""
    each, out, at = [plain(c) for c in word], [], 0
    while at < len(word):
        found = next((g for g in VOWELS if "".join(each[at : at + len(g)]) == g and not DIAERESIS & set(word[at : at + len(g)])), None)
        if found:
            out.append((word[at : at + len(found)], found, True))
        else:
            found = next((g for g in CONSONANTS if "".join(each[at : at + len(g)]) == g), None)
            out.append((word[at : at + len(found)], found, False) if found else (word[at], each[at], word[at] in VOWEL_LETTERS))
        at += len(found) if found else 1
    return out


def onset(cluster: list[str]) -> int:
    """How many of the consonants between two vowels go to the right."""
    if len(cluster) < 2:
        return len(cluster)
    if len(cluster) >= 3 and "".join(cluster[-3:]) in TRIPLES:
        return 3
    doubled = len(cluster) == 2 and cluster[0] == cluster[1]
    return 2 if "".join(cluster[-2:]) in PAIRS and not doubled else 1


def steady(parts: list[str]) -> list[str]:
    """No syllable of one consonant, and none of one letter at the end."""
    out: list[str] = []
    for part in filter(None, parts):
        if out and letters(part) == 1 and not has_vowel(part):
            out[-1] += part
        else:
            out.append(part)
    if len(out) > 1 and letters(out[-1]) == 1:
        out[-2:] = [out[-2] + out[-1]]
    return out


def typographic(parts: list[str], word: str) -> list[str]:
    """Joins until no part has one letter and no break is at an apostrophe, a hyphen or an x or y between vowels."""
    parts = list(parts)

    def join_at(i: int) -> None:
        parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def next_join() -> int | None:
        if letters(parts[0]) < 2:
            return 0
        if letters(parts[-1]) < 2:
            return len(parts) - 2
        for i in range(1, len(parts) - 1):
            if letters(parts[i]) < 2:
                return i - 1
        at = 0
        for i in range(len(parts) - 1):
            at += len(parts[i])
            before, after = word[at - 1 : at], word[at : at + 1]
            before2, after2 = word[at - 2 : at - 1] if at >= 2 else "", word[at + 1 : at + 2]
            if before in APOSTROPHES + "-" or after in APOSTROPHES + "-" and after:
                return i
            if plain(before) in ("x", "y") and has_vowel(before2) and has_vowel(after) or plain(after) in ("x", "y") and has_vowel(before) and has_vowel(after2):
                return i
        return None

    while len(parts) > 1 and (i := next_join()) is not None:
        join_at(i)
    return parts


def core_syllables(word: str, mode: str) -> list[str]:
    known = exception(word) if mode == "pedagogique" else None
    if known:
        return known
    if letters(word) <= 1:
        return [word] if word else []
    own = units(word)
    vowels = [i for i, u in enumerate(own) if u[2]]
    if len(vowels) <= 1:
        return [word]
    cuts = [0] + [right - onset([u[1] for u in own[left + 1 : right]]) for left, right in zip(vowels, vowels[1:], strict=False)] + [len(own)]
    parts = steady(["".join(u[0] for u in own[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    return typographic(parts, word) if mode == "typographique" else parts


@lru_cache(maxsize=200_000)
def analyse(word: str, mode: str = "pedagogique") -> tuple[tuple[str, ...], str]:
    """(syllables of the core, silent ending)."""
    if not letters(word):
        return ((word,) if word else ()), ""
    known = exception(word) if mode == "pedagogique" else None
    if known:
        return tuple(known), ""
    core, ending = silent_ending(word)
    return tuple(core_syllables(core, mode)), ending


def visible(word: str, mode: str = "pedagogique") -> list[str]:
    parts, ending = analyse(word, mode)
    return [*parts[:-1], parts[-1] + ending] if parts else []


def syllabify(token: str, separator: str = "-", mode: str = "pedagogique") -> str:
    """A token with separators; parts at hyphens and apostrophes on their own, elided prefixes whole."""

    def with_apostrophes(word: str) -> str:
        known = exception(word) if mode == "pedagogique" else None
        if known:
            return separator.join(known)
        parts = re.split(f"([{APOSTROPHES}])", word)
        for i in range(0, len(parts), 2):
            elided = i + 1 < len(parts) and plain(parts[i]) in ELIDED
            if letters(parts[i]) and not elided:
                parts[i] = separator.join(visible(parts[i], mode))
        return "".join(parts)

    return "-".join(map(with_apostrophes, token.split("-")))


def shown(word: str, level: str, scope: str = "auto") -> bool:
    """Whether a word is shown in syllables at a level."""
    n, size = len(analyse(word)[0]), letters(word)
    if level == "off" or n <= 1:
        return False
    return scope == "all" or (n >= 3 or size >= 8 if level == "light" else n >= 2 and size >= 4)


TOKEN = re.compile(r"\s+|[^\W\d_]+(?:['’-][^\W\d_]+)*|[0-9]+|.", re.S)


def syllabify_text(text: str, separator: str = "-", mode: str = "pedagogique") -> str:
    return "".join(syllabify(t, separator, mode) if letters(t) else t for t in TOKEN.findall(text))


def syllabify_html(html: str, separator: str = "-", mode: str = "pedagogique") -> str:
    """Only text between tags changes."""
    return "".join(p if p.startswith("<") else syllabify_text(p, separator, mode) for p in re.findall(r"<[^>]+>|[^<]+|<", html))
