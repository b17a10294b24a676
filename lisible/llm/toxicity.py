"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of lexicon words, their nearness to second-person words, capitals, punctuation and
obfuscation rates. Beside a short fixed word list there is a lexicon of words and word beginnings that labelled texts
themselves show to go with the label. Half of a bounded sample of labelled rows teaches that lexicon and the other
half the trees, so that the trees see lexicon densities as they are on new texts; isotonic regression runs on margins
of trees that did not see the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_isotonic, fit_trees, out_of_fold, sigmoid
from .common import SLICE, hand_back, handing_back, materialise, slices

#: Labelled rows that are learnt from at most (the bound of the sample), lexicon entries at most, folds for calibration.
SAMPLE_ROWS, LEXICON_SIZE, FOLDS = 16_000, 3_000, 4
#: Lengths of word beginnings that can enter the lexicon; evidence (nats) that an entry needs.
STEMS, EVIDENCE = (4, 5, 6, 7), 8.0

# Insults in the four languages of the corpora, and second-person words.
INSULTS = frozenset(
    """idiot idiots moron morons stupid scum clown worthless pathetic trash loser losers disgusting dumb garbage fool imbecile
    crétin crétins imbécile débile connard ordure minable abruti pourriture ridicule
    dummkopf trottel abschaum arschloch wertlos erbärmlich widerlich schwachkopf drecksack
    estúpido imbécil basura patético asqueroso inútil payaso escoria""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())

TOKEN = re.compile(r"[^\s]+")
EDGE = ".,;:!?\"'()[]{}«»“”…-_"
#: Letters with signs or digits between them, as in id1ot or s*um.
MASKED = re.compile(r"[^\W\d_]+[0-9@$*!|+]+[^\W\d_]+")
LEET = str.maketrans("013457@$!|+*", "oieastasilti")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NEAR = 5

FEATURES = (
    "log_words", "fixed_density", "fixed_hits", "learnt_density", "learnt_hits", "learnt_weight", "learnt_most", "learnt_distinct", "second_density", "near_second",
    "capitals", "shouted", "exclaimed", "asked", "punctuation", "masked", "masked_hits", "stretched", "digits", "non_ascii", "word_length",
)


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(EDGE) for t in text.lower().split()) if w]


def units_of(words: set[str]) -> set[str]:
    """Words, and beginnings of longer ones marked by *."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def features_of(text: str, lexicon: dict[str, float], openings: set[str]) -> list[float]:
    """openings: the first letters, as many as the shortest stem, of all lexicon entries."""
    raw, words = text.split(), words_of(text)
    n, letters = max(1, len(words)), max(1, len(text))
    short = STEMS[0]
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    learnt, weight, most, seen = [], 0.0, 0.0, set()
    for i, w in enumerate(words):
        if w[:short] in openings:
            best = lexicon.get(w, 0.0)
            for k in STEMS:
                if len(w) > k:
                    best = max(best, lexicon.get(w[:k] + "*", 0.0))
            if best:
                learnt.append(i)
                seen.add(w)
                weight += best
                most = max(most, best)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if second and (fixed or learnt):
        at = np.array(second)
        hits = np.unique(fixed + learnt)
        left = np.searchsorted(at, hits - NEAR)
        near = int(((left < len(at)) & (at[np.minimum(left, len(at) - 1)] <= hits + NEAR)).sum())
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    digits = int(((data >= 48) & (data <= 57)).sum())
    signs = int(((data >= 33) & (data <= 47) | (data >= 58) & (data <= 64) | (data >= 91) & (data <= 96) | (data >= 123) & (data <= 126)).sum())
    high = int((data >= 128).sum())
    masked = MASKED.findall(text) if digits or signs else []
    masked_hits = sum(m.lower().translate(LEET) in INSULTS for m in masked)
    shouted = sum(len(w) > 2 and w.isupper() for w in raw) if upper > 2 else 0
    return [
        float(np.log1p(n)), len(fixed) / n, float(len(fixed)), len(learnt) / n, float(len(learnt)), weight / n, most, float(len(seen)), len(second) / n, near / n,
        upper / letters, shouted / n, text.count("!") / n, text.count("?") / n, signs / letters, len(masked) / n, float(masked_hits), len(STRETCHED.findall(text)) / n, digits / letters, high / letters, letters / n,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        x = matrix(texts, self.lexicon)
        z = sigmoid(self.trees.margin(x))
        return np.clip(np.interp(z, *self.knots), 0.0, 1.0)


def matrix(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    openings = {e.rstrip("*")[: STEMS[0]] for e in lexicon}
    return np.array([features_of(t, lexicon, openings) for t in texts], float).reshape(len(texts), len(FEATURES))


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _text(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _learn_lexicon(sample: DataFrame, positive: int, negative: int) -> dict[str, float]:
    """Entries whose share of positive texts is higher than chance allows, with their log-odds; at most LEXICON_SIZE."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for text, y in zip(_text(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                of[y].update(units_of(set(words_of(text))))
        # an entry no positive text has cannot count; its negative texts in other tasks are added by the next step
        for y in (0, 1):
            keys = list(of[y])
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([y] * len(part), pa.int32()), pa.array([of[y][k] for k in part], pa.int64())], ["unit", "y", "n"])

    rate = positive / (positive + negative)
    counts = sample.select("text", "y").mapInArrow(handing_back(tally), "unit string, y int, n long").groupBy("unit").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
    share = F.col("p") / F.col("n")
    evidence = F.col("p") * F.log(share / F.lit(rate)) + F.when(F.col("n") > F.col("p"), (F.col("n") - F.col("p")) * F.log((1 - share) / F.lit(1 - rate))).otherwise(0.0)
    odds = F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5) * F.lit((negative + 1) / (positive + 1)))
    best = counts.where((F.col("p") > 2) & (share > 2 * F.lit(rate))).select("unit", evidence.alias("e"), odds.alias("w")).where(F.col("e") >= EVIDENCE)
    return {r.unit: float(r.w) for r in best.orderBy(F.desc("e"), "unit").limit(LEXICON_SIZE).collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most SAMPLE_ROWS labelled rows that are not held out, chosen by a hash of the id.

    Several labels of one id are averaged; null labels and labels without a text do not count. With labels of one
    kind only, or none, the model is the constant share of positive labels (0 without labels).
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("of_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("of_id"), "of_id").limit(SAMPLE_ROWS)
    half = F.pmod(F.xxhash64("of_id", F.lit(7)), F.lit(2)).cast("int").alias("half")
    chosen = materialise(chosen.select("of_id", "y", half), "toxicity-labels")
    # SAMPLE_ROWS rows at most: safe to broadcast
    sample = materialise(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("of_id")).select("of_id", "text", "y", "half"), "toxicity-sample")
    counts = {(r.half, r.y): r.n for r in sample.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    base = sum(n for (_, y), n in counts.items() if y) / total if total else 0.0
    if any(counts.get(k, 0) < 2 for k in ((0, 0), (0, 1), (1, 0), (1, 1))):
        return Model({}, None, None, base)
    lexicon = _learn_lexicon(sample.where("half = 0"), counts[0, 1], counts[0, 0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(_text(batch.column(0)), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "of_id", "x"])

    kind = sample.schema["of_id"].dataType.simpleString()
    rows = sample.where("half = 1").select("text", "y", "of_id").mapInArrow(handing_back(measure), f"y int, of_id {kind}, x array<double>").orderBy("of_id", "x").collect()  # half the bound, some twenty numbers each
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    margins = out_of_fold(x, y, min(FOLDS, len(y)))
    return Model(lexicon, fit_trees(x, y), fit_isotonic(sigmoid(margins), y), base)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """id and score for every row, by nothing but its whole text; no shuffle.

    Null and empty texts are scored as the empty text; null ids stay null; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_SIZE entries and some trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(_text(part.column(1))), pa.float64())], [part.schema.names[0], score_col])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(handing_back(run), f"`{id_col}` {kind}, `{score_col}` double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (1 where score >= 0.5) for every row of docs; see fit() and score()."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns. The text alone decides, row by row, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        found = [model.value.score(_text(texts.slice(at, SLICE))) for at in range(0, len(texts), SLICE)]
        hand_back()
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return docs.where(toxic(F.col(text_col)) < 0.5)
