"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from strict patterns (the base finds, which always stay) and from looser ones. Four labelers vote on
every candidate, or abstain: a regex for its form, a gazetteer, the words around it and the marks beside it; none knows which
candidates are base finds. Expectation-maximisation over the counts of
vote patterns, of which there are at most a few hundred however large the corpus, estimates how reliable each labeler
is; the estimated labels then train a logistic span classifier on features of the span, again over counts. A loose
candidate is reported where the classifier's probability is at least ACCEPT.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, table
from .spans import apart, fixed, joined, locate

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
ROUNDS = 50
#: Code points before and after a candidate that the context labeler reads.
BEFORE, AFTER = 40, 20

# Fixed patterns, possessive where giving back could never lead to a match; a match can begin only where a run of the
# class of its first character begins, or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Looser patterns.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}){1,4}"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.,:/-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"
LOOSE_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

#: What the gazetteer knows: top-level names (two letters: a country's), country calling codes, issuers' beginnings of card
#: numbers with their lengths, networks of the Internet that no host of a person has, and areas of identity numbers unused.
TOP_NAMES = "com net org edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post dev app online site shop store blog cloud tech email club live news life world agency academy".split()
MAIL_ENDS = r"(?i)(?:\.|dot[\])}]?) ?(?:" + "|".join(TOP_NAMES) + r"|[a-z]{2})$"
CALLING_CODES = r"^\+(?:1|7|20|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|27|29[0179]|3[0-469]|35[0-9]|37[0-9]|38[0-35-79]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|8[1246]|85[02356]|88[06]|9[0-58]|96[0-8]|97[0-79]|99[2-68])"
NATIONAL_STARTS = r"^(?:0[1-9]|1?[2-9][0-9]{2}[2-9])"
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12,14}|3[47][0-9]{13}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12,15}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{11,17})$"
NO_HOSTS = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\."
UNUSED_AREAS = "^(?:000|666|9)"
#: What the regex labeler takes for well formed, and for something else.
FORMS = {
    "email": (r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@| ?[(\[{]at[)\]}] ?)[A-Za-z0-9][A-Za-z0-9. ()\[\]{}-]*[A-Za-z]{2}$", r"\.\.|^[.%+-]|[.-]@|@-|-\.|\.-|[0-9]$"),
    "ip": (r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", r"(?:^|\.)(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})(?:\.|$)"),
    "phone": (r"^\+[0-9]{1,3}[ ().-]*(?:[0-9]{2,5}[ ().-]*){2,5}$|^\(?0[0-9]{1,4}\)?(?:[ /.-][0-9]{2,5}){1,4}$|^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$", r"^(?:19|20)[0-9]{2}[-./](?:0[1-9]|1[0-2])[-./][0-3][0-9]$|^[0-3][0-9][-./](?:0[1-9]|1[0-2])[-./](?:19|20)[0-9]{2}$|^(?:[^0-9]*[0-9]){1,6}[^0-9]*$|^(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2}$"),
    "id": (r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"-00-|-0000$"),
}
#: Words that stand near personal data, and words that stand near other numbers.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|addr(?:ess)?|host|server|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|telephone|call|fax|mobile|cell|telefon|appelez|tél|llame|anruf)\b",
    "id": r"(?i)\b(?:ssn|social security|national id|taxpayer)\b",
}
OTHER_CUES = r"(?i)\b(?:isbn|issn|version|order|invoice|page|pp|vol|section|figure|date|year|part|model|serial|score)\b"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; meant for short strings."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, strict: Column, well: Column, wrong: Column, known: Column, unknown: Column, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """What is kept of a candidate: whether it is a base find (which neither a labeler nor the classifier sees), the votes
    of the regex, gazetteer, context and surroundings labelers (0: abstains), and the classifier's features."""
    digits = _digits(m)
    near = F.concat_ws(" ", F.substring(before, -BEFORE, BEFORE), F.substring(after, 1, AFTER))
    dull = digits.rlike(r"^(?:([0-9])\1{5,}|0?123456.*)$") | before.rlike(r"[$€£#=_v]$") | after.rlike(r"^(?:%|_| ?(?:EUR|USD|kg|km|mm|cm)\b)")
    form, name, cue, odd = _vote(well & ~wrong, wrong), _vote(known, unknown), _vote(near.rlike(CUES[kind]), near.rlike(OTHER_CUES)), _vote(F.lit(False), dull)
    return {
        "base": strict,
        "votes": F.array(form, name, cue, odd),
        "f": F.array(F.least(F.length(m), F.lit(60)).__truediv__(20).cast("int"), F.least(F.length(digits), F.lit(20)).__truediv__(5).cast("int"), form, name, cue, odd),
    }


def _found(df: DataFrame, text: str) -> DataFrame:
    t, no = F.col(text), F.lit(False)

    def told(kind: str, strict, known, unknown, m: Column, b: Column, a: Column) -> dict[str, Column]:
        well, wrong = FORMS[kind]
        return _candidate(kind, strict, m.rlike(well), m.rlike(wrong), known, unknown, m, b, a)

    def card(m: Column, b: Column, a: Column) -> dict[str, Column]:
        d = _digits(m)
        good = F.when(F.length(d).between(13, 19), luhn(d)).otherwise(no)
        return _candidate("card", good, good, ~good, d.rlike(ISSUERS), ~d.rlike(ISSUERS), m, b, a)

    email = lambda strict: lambda m, b, a: told("email", F.lit(strict), m.rlike(MAIL_ENDS), ~m.rlike(MAIL_ENDS), m, b, a)
    ip = lambda m, b, a: told("ip", m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), ~m.rlike(NO_HOSTS), m.rlike(NO_HOSTS), m, b, a)
    phone = lambda m, b, a: told("phone", F.length(_digits(m)).between(9, 15), m.rlike(CALLING_CODES), ~m.rlike(CALLING_CODES), m, b, a)
    loose_phone = lambda m, b, a: told("phone", no, _digits(m).rlike(NATIONAL_STARTS), ~_digits(m).rlike(NATIONAL_STARTS), m, b, a)
    loose_id = lambda m, b, a: told("id", no, ~m.rlike(UNUSED_AREAS), m.rlike(UNUSED_AREAS), m, b, a)
    numbers = t.rlike("(?:[0-9][ -]?){12}[0-9]")
    df = locate(df, text, EMAIL, "_email", email(True), t.contains("@"))
    df = locate(df, text, IP, "_ip", ip, t.rlike(r"[0-9]\.[0-9]++\."))
    df = locate(df, text, CARD, "_card", card, numbers)
    df = locate(df, text, PHONE, "_phone", phone, t.contains("+"))
    df = locate(df, text, LOOSE_EMAIL, "_l_email", email(False), t.rlike(r"[(\[{]at[)\]}]"))
    df = locate(df, text, LOOSE_PHONE, "_l_phone", loose_phone, t.rlike("[0-9]{2}[) ./-]{1,2}[0-9]{2}"))
    df = locate(df, text, LOOSE_ID, "_l_id", loose_id, t.rlike("[0-9]-[0-9]{2}-[0-9]"))

    def numbered(spans: str, nr: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(nr).alias("nr"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["base"].alias("base"), s["votes"].alias("votes"), s["f"].alias("f")))

    strict = F.concat(*(numbered(f"_{k}", i, k) for i, k in enumerate(KINDS)))
    loose = F.concat(numbered("_l_email", 0, "email"), numbered("_l_phone", 3, "phone"), numbered("_l_id", 4, "id"))
    df = df.withColumn("_strict", F.array_sort(strict)).withColumn("_loose", loose)
    # Of the strict patterns' matches, those that fail their tests are loose candidates as well, cards only where long enough.
    df = df.withColumn("base", F.filter("_strict", lambda s: s["base"]))
    failed = F.filter("_strict", lambda s: ~s["base"] & (s["kind"] != "card") | ~s["base"] & (s["end"] - s["start"] >= 13))
    df = df.withColumn("_loose", F.concat("_loose", failed))
    df = fixed(df, _weak=F.col("_loose"), _sure=F.col("base")).drop("base").withColumnRenamed("_sure", "base")
    df = df.withColumn("loose", apart(F.col("_weak"), F.col("base")))
    return df.drop("_strict", "_loose", "_weak", *(f"_{k}" for k in KINDS), "_l_email", "_l_phone", "_l_id")


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): ({(kind, votes): probability of personal data}, model).

    Labelers are taken as independent given the truth, each with its own chances of voting -1, 0 and 1 for either truth;
    each kind has its own share of true candidates. Counts are smoothed by one each. Begins from the share of yes votes.
    """
    given = {(k, v): max(0.05, min(0.95, 0.5 + 0.25 * sum(v))) for k, v, _ in patterns}
    model: dict = {}
    for _ in range(rounds):
        share: dict = {}
        chance: dict = {}
        for k, v, n in patterns:
            p = given[k, v]
            yes, all_ = share.get(k, (1.0, 2.0))
            share[k] = (yes + n * p, all_ + n)
            for j, vote in enumerate(v):
                for truth, w in ((1, n * p), (0, n * (1 - p))):
                    chance[j, truth, vote] = chance.get((j, truth, vote), 1.0) + w
        total = {(j, t): sum(chance.get((j, t, x), 1.0) for x in (-1, 0, 1)) for j, t, _ in chance}
        for k, v, _ in patterns:
            score = math.log(share[k][0] / (share[k][1] - share[k][0]))
            for j, vote in enumerate(v):
                score += math.log(chance.get((j, 1, vote), 1.0) / total[j, 1]) - math.log(chance.get((j, 0, vote), 1.0) / total[j, 0])
            given[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        model = {"share": {k: y / a for k, (y, a) in share.items()}, "chance": {key: n / total[key[0], key[1]] for key, n in chance.items()}}
    return given, model


def fit(rows: list[tuple[tuple, float, float]], rounds: int = 200, decay: float = 1e-3) -> dict[tuple[int, object], float]:
    """Logistic weights of the values of categorical features from (values, true share, count), by gradient steps.

    A weight for each (place, value) and a bias at (-1, None); full-batch steps with diagonal scaling.
    """
    weights: dict = {(-1, None): 0.0}
    seen: dict = {(-1, None): 0.0}
    for values, _, n in rows:
        for key in ((-1, None), *enumerate(values)):
            weights.setdefault(key, 0.0)
            seen[key] = seen.get(key, 0.0) + n
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for values, p, n in rows:
            keys = ((-1, None), *enumerate(values))
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in keys)))))
            for k in keys:
                slope[k] += n * (p - guess)
        for k in weights:
            weights[k] += slope[k] / (seen[k] + 1.0) - decay * weights[k]
    return weights


def classify(found: DataFrame) -> dict[tuple[int, object], float]:
    """The classifier's weights for a table with columns base and loose: patterns are counted, never collected one by one.

    At most 5 kinds times 4 * 5 lengths times 3^4 votes, which are features too, can occur.
    """
    every = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.kind", "s.votes", "s.f")
    counted = [(r.kind, tuple(r.votes), tuple(r.f), r.n) for r in every.groupBy("kind", "votes", "f").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "f").collect()]
    votes: dict = {}
    for kind, v, _, n in counted:
        votes[kind, v] = votes.get((kind, v), 0) + n
    given, _ = reliabilities([(k, v, n) for (k, v), n in votes.items()])
    return fit([((kind, *f), given[kind, v], float(n)) for kind, v, f, n in counted])


def probability(s: Column, weights: dict[tuple[int, object], float]) -> Column:
    score = F.lit(weights.get((-1, None), 0.0))
    for (place, value), w in weights.items():
        if place >= 0:
            at = s["kind"] if place == 0 else F.element_at(s["f"], place)
            score = score + F.when(at == value, F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The columns in `keep`, base and spans (arrays of struct<nr, start, end, kind>) by kind, then start; a row per row.

    base holds the strict finds; spans has the loose candidates besides that the classifier accepts, kind `id` being one
    that base never has. Accepted candidates never overlap base finds. A null or empty text has none; repeated rows each
    get theirs; an empty table gives an empty one. Columns may have any names; `keep` must not name base or spans.
    """
    own = docs.select(F.struct(F.lit(0).alias("_"), *(column(docs, c) for c in keep)).alias("_keep"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("_text"))
    found = materialize(_found(own, "_text").select("_keep", "base", "loose"), "pii")
    weights = classify(found)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["nr"].alias("nr"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    good = F.filter("loose", lambda s: probability(s, weights) >= accept)
    return found.select(*(F.col("_keep").getField(c).alias(c) for c in keep), plain("base").alias("base"), F.array_sort(F.array_distinct(F.concat(plain("base"), plain(good)))).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
