"""Personal data by weak supervision, in DataFrame operations only.

Four kinds are exact: e-mail addresses, IP addresses, card numbers and phone numbers of fixed patterns; these spans
always stay. Beside them there are looser candidates (masked addresses, national phone numbers, numbers of a card's
length that the base rule drops, quads with parts over 255, IBANs, identity numbers, keys and tokens, names after a
title); many of these are none, and telling them apart is the method's work. Regular-expression, gazetteer and context labelers vote on every
candidate; expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors train a naive Bayes classifier over features of the span, which decides on the looser candidates.

Offsets come from the text between matches, so a text is read a fixed number of times. Start conditions keep every
pattern linear in the text: a match begins where a run of its first characters begins, or where the last match ended.
What is gathered over the corpus are counts of vote patterns and feature values, whose number is fixed.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base kinds, in the order of the digest, and their patterns. Possessive where nothing can follow
# that a shorter match would need.
KINDS = ("email", "ip", "card", "phone", "iban", "name", "ssn", "secret")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Looser candidates: kind and pattern.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT|\.)[\])]|\.) ?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"),
    ("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?"),
)
# Gazetteers.
ENDINGS = "com|org|net|edu|gov|info|io|eu|fr|de|es|uk|ch|at|be|it|nl|us|ca|mx|co|test|example"
GIVEN = "James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Anna|Maria|Peter|Paul|Thomas|Hans|Karl|Klaus|Ursula|Jean|Pierre|Michel|Marie|Nathalie|Isabelle|Juan|José|Carlos|Luis|Carmen|Ana|Laura|Sophie|Martin"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write to|schreib|courriel|correo", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|mastercard|amex|carte|karte|tarjeta|credit",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential",
    "phone": "phone|tel|call|fax|mobile|mobil|appel|anruf|llam", "iban": "iban|account|konto|compte|cuenta|bank", "ssn": "ssn|social security|identity|ausweis",
}
#: What some issuers begin their keys with.
KEY_FORMS = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_.*|xox[abpr]-.*|sk-.*|eyJ.*)$"
AGAINST = r"(?:version|commit|checksum|revision|order|invoice|v|vol|chapter|section|page|pp|isbn|issn|doi|no|nr|figure|table|kapitel|chapitre|capítulo)[.: #]*$"
CONTEXT, EM_ROUNDS, SMOOTHING, LABELERS, CHUNK = 40, 40, 1.0, 6, 64
#: Spans' worth of smoothing towards a feature value's overall share.
STRENGTH = 4.0


def located(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<m, start, end, before, after>> of the matches `found` of a pattern, offsets in code points.

    Offsets are sums over the CHUNK matches at most before it in its chunk and over the chunks before, so the work for
    each match has a bound and no array grows match by match.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next")),
        lambda x: F.struct(x["m"].alias("m"), F.length(x["gap"]).cast("long").alias("skip"), F.length(x["m"]).cast("long").alias("size"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")),
    )
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    once = lambda value, use: F.transform(F.array(value), use)[0]  # the value is made once, not in each step of a lambda

    def offsets(own: Column) -> Column:
        sized = F.struct(own.alias("own"), F.transform(own, lambda x: x["skip"] + x["size"]).alias("sizes"))
        chunks = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t["sizes"]) - 1) / CHUNK).cast("int")), lambda c: total(F.slice(t["sizes"], c * CHUNK + 1, F.lit(CHUNK))))
        based = lambda t: F.struct(t["own"].alias("own"), t["sizes"].alias("sizes"), once(chunks(t), lambda sums: F.transform(sums, lambda _, c: total(F.slice(sums, 1, c)))).alias("base"))

        def at(t: Column) -> Column:
            start = lambda x, i: F.get(t["base"], F.floor(i / CHUNK).cast("int")) + total(F.slice(t["sizes"], F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)) + x["skip"]
            placed = F.transform(t["own"], lambda x, i: F.struct(x["m"].alias("m"), start(x, i).alias("start"), x["size"].alias("size"), x["before"].alias("before"), x["after"].alias("after")))
            return F.transform(placed, lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), x["before"].alias("before"), x["after"].alias("after")))

        return once(sized, lambda t: once(based(t), at))

    return once(whole, offsets)


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine if over nine; the sum is divisible by ten."""
    reversed_digits = F.split(F.reverse(digits), "")
    worth = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """What a base match must fulfil besides its pattern."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _votes(kind: str, base: bool, x: Column) -> Column:
    """One vote a labeler: 1 for, 0 against, -1 none. Regular expressions, gazetteers, context."""
    m, before, after = x["m"], x["before"], x["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
    vote = lambda condition, other=no: F.when(condition, yes).otherwise(other)
    veto = lambda condition, other: F.when(condition, no).otherwise(other)
    strict = {
        "card": vote(F.length(digits).between(13, 19) & luhn(digits)), "iban": vote(F.length(F.regexp_replace(m, " ", "")).between(15, 34)),
        "ssn": veto(m.rlike("^(?:000|666|9)|-00-|-0000$"), yes), "secret": vote(F.length(F.regexp_replace(m, "[^0-9]", "")) >= 4), "ip": no, "phone": vote(F.length(digits).between(9, 12)),
    }.get(kind, none)
    gazetteer = {
        "email": vote(m.rlike(rf"(?i)(?:\.|\W)(?:{ENDINGS})$")), "ip": veto(m.rlike(r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\."), yes), "card": vote(digits.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)")),
        "phone": vote(digits.rlike(f"^(?:{CALLING})")) if base else veto(digits.rlike("^[01]"), none), "name": vote(m.rlike(rf" (?:{GIVEN})(?: |$)"), none), "secret": vote(m.rlike(KEY_FORMS), none),
    }.get(kind, none)
    # a digest may be anything, so a key without a word that says so is voted against; other kinds have forms of their own
    cue = vote(before.rlike(f"(?i)(?:{CUES[kind]})"), no if kind == "secret" else none) if kind != "name" else none
    against = veto(before.rlike("(?i)(?<![a-z])" + AGAINST), yes)
    edges = veto(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"[\p{L}\p{N}]"), yes)
    size = vote(F.length(m) <= {"email": 64, "ip": 15, "card": 25, "phone": 24, "name": 40, "secret": 128}.get(kind, 42))
    return F.array(yes if base else strict, gazetteer, cue, against, edges, size)


def _features(kind: str, x: Column) -> Column:
    """Discrete features of a span, `name=value`; few values each."""
    m = x["m"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    cap = lambda c, most: F.least(c, F.lit(most)).cast("string")
    return F.array(
        F.lit(f"kind={kind}"), F.concat(F.lit(f"digits={kind}:"), cap(digits, 20)), F.concat(F.lit(f"size={kind}:"), cap(F.floor(F.length(m) / 4), 12)),
        F.concat(F.lit(f"separators={kind}:"), cap(F.length(F.regexp_replace(m, r"[\p{L}\p{N}]", "")), 8)),
        F.concat(F.lit("left="), F.when(x["before"].rlike(r"[\p{L}\p{N}]$"), "glued").when(x["before"].rlike(r"[\s(\[:]$"), "open").when(x["before"] == "", "none").otherwise("sign")),
        F.concat(F.lit("right="), F.when(x["after"].rlike(r"[\p{L}\p{N}]"), "glued").when(x["after"] == "", "none").otherwise("open")),
        F.concat(F.lit("cue="), x["votes"][2].cast("string")), F.concat(F.lit("against="), x["votes"][3].cast("string")),
    )


def candidates(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep, base array<struct<kind int, start, end>>, loose array<struct<kind int, start, end, votes, features>>, and votes and features of the base spans."""
    patterns = [*BASE.items(), *LOOSE]
    out = df.select(*keep, text.alias("text"))
    text = F.col("text")
    found = {f"m{i}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for i, (_, p) in enumerate(patterns)}
    found["m0"] = F.when(F.contains(text, F.lit("@")), found["m0"])
    out = out.withColumns(found)
    nothing = F.array().cast("array<struct<m:string,start:bigint,end:bigint,before:string,after:string>>")
    out = out.withColumns({f"s{i}": F.when(F.size(F.coalesce(F.col(f"m{i}"), F.array())) > 0, located(text, p, F.col(f"m{i}"))).otherwise(nothing) for i, (_, p) in enumerate(patterns)})

    def spans(own: Column, kind: str, base: bool) -> Column:
        voted = F.transform(own, lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end"), x["before"].alias("before"), x["after"].alias("after"), _votes(kind, base, x).alias("votes")))
        return F.transform(voted, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["votes"].alias("votes"), _features(kind, x).alias("features")))

    # numbers of a card's length that are none by the base rule, and quads with parts over 255, are candidates like the rest
    n_digits = lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", ""))
    other_card = lambda x: n_digits(x).between(13, 19) & ~valid("card", x["m"])
    other_ip = lambda x: ~valid("ip", x["m"])
    base = F.concat(*(spans(F.filter(f"s{i}", (lambda k: lambda x: valid(k, x["m"]))(k)), k, True) for i, k in enumerate(BASE)))
    loose = F.concat(spans(F.filter(f"s{list(BASE).index('ip')}", other_ip), "ip", False), spans(F.filter(f"s{list(BASE).index('card')}", other_card), "card", False), *(spans(F.col(f"s{len(BASE) + i}"), k, False) for i, (k, _) in enumerate(LOOSE)))
    out = out.select(*(c for c in out.columns[: len(keep)]), base.alias("base"), loose.alias("loose"))
    # a looser span inside or across a base span adds nothing
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn("loose", F.when(F.size("loose") > 0, apart).otherwise(F.col("loose")))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """From votes, n: one row with prior, hit and miss: the share of spans that are right, and for each labeler the
    chance of a vote for a span that is right and for one that is wrong. Expectation-maximisation over the at most
    3^LABELERS patterns, started from labelers that are right more often than not."""
    one = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("all"))

    def posterior(p: Column, state: Column) -> Column:
        terms = F.transform(
            p["votes"],
            lambda v, i: F.when(v == 1, F.log(F.get(state["hit"], i) / F.get(state["miss"], i))).when(v == 0, F.log((1 - F.get(state["hit"], i)) / (1 - F.get(state["miss"], i)))).otherwise(0.0),
        )
        return 1 / (1 + F.exp(-F.log(state["prior"] / (1 - state["prior"])) - F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))

    def total(weighted: Column, weight) -> Column:
        return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + weight(x))

    def step(state: Column, _: Column) -> Column:
        weighted = F.array(F.transform("all", lambda p: F.struct(p["votes"].alias("votes"), (p["n"] * posterior(p, state)).alias("right"), p["n"].alias("n"))))

        def rates(w: Column, share) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(LABELERS - 1)),
                lambda i: (total(w, lambda x: F.when(F.get(x["votes"], i) == 1, share(x)).otherwise(0.0)) + SMOOTHING) / (total(w, lambda x: F.when(F.get(x["votes"], i) >= 0, share(x)).otherwise(0.0)) + 2 * SMOOTHING),
            )

        return F.transform(
            weighted,
            lambda w: F.struct(
                ((total(w, lambda x: x["right"]) + SMOOTHING) / (total(w, lambda x: x["n"]) + 2 * SMOOTHING)).alias("prior"),
                rates(w, lambda x: x["right"]).alias("hit"), rates(w, lambda x: x["n"] - x["right"]).alias("miss"),
            ),
        )[0]

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), LABELERS).alias("hit"), F.array_repeat(F.lit(0.3), LABELERS).alias("miss"))
    ran = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step).alias("model"))
    return ran.select("model.*")


def _posterior(votes: Column, model, prior: float) -> Column:
    """Of a vote array under the estimated reliabilities (a row of numbers)."""
    logit = F.lit(log(prior / (1 - prior)))
    for i, (a, b) in enumerate(zip(model.hit, model.miss, strict=True)):
        logit = logit + F.when(F.get(votes, F.lit(i)) == 1, log(a / b)).when(F.get(votes, F.lit(i)) == 0, log((1 - a) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    spans lists base spans and what the classifier adds, `kind:start:end` by kind (email, ip, card, phone, iban, name,
    ssn, secret), then start; offsets count code points. Null and empty texts have no spans and the digest of the empty
    string; null ids stay null; repeated rows give repeated rows; an empty table gives an empty one; other columns are
    not read. Without any candidate there is nothing to learn and nothing is added.
    """
    found = materialise(candidates(df, F.coalesce(F.col(text_col), F.lit("")), [F.col(id_col).alias("id")]), "pii")
    spans = found.where((F.size("base") > 0) | (F.size("loose") > 0)).select(F.explode(F.concat("base", "loose")).alias("x")).select("x.votes", "x.features")
    model = reliabilities(spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))).first()
    right = _posterior(F.col("votes"), model, model.prior)
    counted = spans.select(F.explode("features").alias("feature"), right.alias("p")).groupBy("feature").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q"))
    sums = spans.agg(F.coalesce(F.sum(right), F.lit(0.0)).alias("p"), F.coalesce(F.sum(1 - right), F.lit(0.0)).alias("q"))
    # the classifier: a log-odds weight for each of the few hundred feature values, in one row
    share = STRENGTH * (F.col("p") + F.col("q")) / (F.col("all_p") + F.col("all_q"))
    weight = F.log((F.col("p") + share) / (F.col("all_p") + STRENGTH)) - F.log((F.col("q") + share) / (F.col("all_q") + STRENGTH))
    weights = counted.join(F.broadcast(sums.select(F.col("p").alias("all_p"), F.col("q").alias("all_q"))), F.lit(True)).select("feature", weight.alias("w"))
    learnt = {r.feature: float(r.w) for r in weights.collect()}
    whole = sums.first()
    odds = log((whole.p + 0.5) / (whole.q + 0.5))
    table = F.create_map(*(F.lit(x) for pair in sorted(learnt.items()) for x in pair)) if learnt else F.create_map(F.lit(""), F.lit(0.0))
    score = lambda x: F.lit(odds) + F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    # a looser candidate must convince the classifier and the labelers alike, and the latter at even odds: that most
    # spans of a corpus, the base ones, are right says nothing for it
    added = F.filter("loose", lambda x: (score(x) >= 0) & (_posterior(x["votes"], model, 0.5) >= 0.5))
    narrow = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))
    text_of = lambda spans: F.array_join(F.transform(F.array_sort(narrow(spans)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias(id_col), *(count(k) for k in BASE), F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat(narrow("base"), narrow(added))).alias("spans"))
