"""Operator 7, PII: weak supervision. Labelers vote on candidate spans, expectation-maximisation estimates their reliabilities, and a span
classifier is trained on the result.

Candidates: the four base patterns (e-mail, IP address, card and phone number), and wider ones (secrets, phone numbers without a plus
sign, identity numbers, e-mails that are spelled out, names after a title). Labelers vote yes (1), no (-1) or nothing (0) on each:
  form     regex: the strict form of its kind
  list     gazetteer: known ending, country code, card issuer, address range, or given name
  cue      context: words before the span that speak for its kind, or against any
  edge     context: whether the span stands by itself or inside a longer token
Only the counts of equal vote patterns (at most 9 * 3**4) go to the driver: a two-class latent model is fitted to them by expectation-maximisation, and
a logistic regression on kind and votes learns its posteriors. The classifier is a Spark expression; base spans stay whatever it says,
other candidates are added if its probability is at least `accept`, unless they overlap a base span or an added one before them. All of it
is linear in the text and its matches. Nothing but DataFrame functions runs.

Defined cases: null text is empty; matches that fail a check are dropped and not retried; rows with equal doc_ids are rows of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "local_phone", "id_number", "spelled_email", "name"]
ACCEPT = 0.5
#: Patterns; possessive where nothing that follows could make them give back, so long runs need no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "id_number": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "spelled_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}\x20[A-Z][a-z]{1,30}\b",
}
CUES = {
    "email": "mail|contact|write|reply|@", "ip": "ip|host|server|address|from|login|client", "card": "card|visa|pay|credit|debit|account", "phone": "phone|tel|call|mobile|fax|whatsapp", "secret": "token|key|secret|password|auth|api",
    "local_phone": "phone|tel|call|mobile|fax", "id_number": "ssn|social|security|tax|identity", "spelled_email": "mail|contact|write|reply", "name": "dear|patient|client|name|contact|by",
}
AGAINST = "version|release|isbn|issn|section|chapter|commit|sha1|md5|checksum|build|page"
#: Gazetteers, written down by hand: common endings of addresses, and common given names of English, French, German and Spanish speakers.
ENDINGS = """
com org net edu gov mil int info biz io co dev app ai me tv cc eu us ca mx br ar cl pe ve uk ie fr de es pt it nl be lu ch at dk se no fi is pl cz sk hu ro bg gr tr
ru ua by lt lv ee hr si rs il ae sa eg za ng ke ma in pk bd lk cn hk tw jp kr sg my th vn id ph au nz test example invalid
""".split()
GIVEN = """
james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy
anthony betty mark sandra steven ashley paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward laura emma olivia noah liam
jean marie pierre louise jacques jeanne michel françoise philippe monique alain catherine nicolas nathalie françois isabelle julien sophie antoine camille luc claire
hans klara peter ursula wolfgang monika klaus petra stefan sabine andreas anna jürgen renate michaela heike markus julia felix lena lukas katharina friedrich greta
carlos maria jose carmen antonio josefa manuel isabel francisco dolores juan pilar javier teresa miguel lucia alejandro sofia pedro marta luis elena diego paula
""".split()
#: Items of a block of a running sum.
STEP = 256
LABELERS = ["form", "list", "cue", "edge"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    add = lambda t, i: t + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise((F.substring(back, i, F.lit(1)).cast("int") * 2).cast("int") - F.when(F.substring(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(x: Column) -> Column:
    """Parts of an address as numbers; a part of more than three digits, leading zeros aside, counts as 999."""
    return F.transform(F.split(x, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+(?=.)", "")) > 3, 999).otherwise(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int")))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(_octets(x), lambda p: p <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _form(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    yes = {
        "email": x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"),
        "ip": ~x.rlike(r"(?:^|\.)0[0-9]"),
        "card": n.between(13, 19),
        "phone": n.between(10, 15),
        "secret": F.length(x).isin(32, 40, 64, 128) & x.rlike("[0-9]") & x.rlike("[a-fA-F]"),
        "local_phone": x.rlike(r"^\(?[2-9]"),
        "id_number": ~x.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "spelled_email": x.rlike(r"(?i)(?:\.|[\[(]dot[\])])\x20?[a-z]{2,24}$"),
        "name": F.length(x) >= 10,
    }[kind]
    return F.when(yes, 1).otherwise(-1)


def _list(kind: str, x: Column) -> Column:
    if kind in ("email", "spelled_email"):
        return F.when(F.lower(F.regexp_extract(x, r"([A-Za-z]+)$", 1)).isin(ENDINGS), 1).otherwise(-1)
    if kind == "ip":
        first, second = F.get(_octets(x), F.lit(0)), F.get(_octets(x), F.lit(1))
        return F.when((first == 0) | (first == 127) | (first >= 224), -1).when((first == 10) | ((first == 192) & (second == 168)) | ((first == 172) & second.between(16, 31)), 0).otherwise(1)
    if kind == "card":
        return F.when(F.substring(_digits(x), 1, 1).isin("3", "4", "5", "6"), 1).otherwise(0)
    if kind == "phone":
        return F.when(x.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 1).otherwise(0)
    if kind == "name":
        return F.when(F.lower(F.regexp_extract(x, r"\x20([A-Z][a-z]+)\x20", 1)).isin(GIVEN), 1).otherwise(0)
    return F.lit(0)


_PLACED = "struct<start:int,stop:int,x:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, n: Column, carry: Column, step, kind: str) -> Column:
    """What step(carry, item) -> (carry, value or null) makes of the n items in order; `kind`: the type of the values.

    It goes in blocks of STEP items, so that the array that grows is short, and the work linear in the items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(s: Column, i: Column) -> Column:
        after, value = step(s["carry"], F.get(items, i))
        return F.struct(after.alias("carry"), F.when(value.isNotNull(), F.concat(s["out"], F.array(value))).otherwise(s["out"]).alias("out"))

    def block(s: Column, b: Column) -> Column:
        inner = F.aggregate(F.sequence(b * STEP, F.least((b + 1) * STEP, n) - 1), F.struct(s["carry"].alias("carry"), empty.alias("out")), one)
        return _let(inner, lambda r: F.struct(r["carry"].alias("carry"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(n > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), start, block)["out"])).otherwise(empty)


def placed_matches(text: Column, kind: str) -> Column:
    """Valid matches of a kind with their places (code points) and surroundings. Matches and the pieces between them give the places by a running sum; what fails its check enters no array."""
    pattern = PATTERNS[kind]

    def unfold(h: Column) -> Column:
        found, pieces = h["found"], h["pieces"]

        def step(at: Column, i: Column) -> tuple[Column, Column]:
            x, begin = F.get(found, i), at + F.length(F.get(pieces, i))
            stop = begin + F.length(x)
            one = F.struct(begin.alias("start"), stop.alias("stop"), x.alias("x"), F.lower(F.substring(F.get(pieces, i), -24, 24)).alias("before"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after"))
            return stop, F.when(_valid(kind, x), one)

        return F.when(F.size(found) > 0, _let(F.sequence(F.lit(0), F.size(found) - 1), lambda i: _fold(i, F.size(found), F.lit(0), step, _PLACED)))

    made = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), unfold)
    return F.coalesce(made, F.array().cast(f"array<{_PLACED}>"))


def spans(text: Column, kind: str, guard: Column) -> Column:
    """Candidates of a kind: start, end (code points), votes."""
    cue = lambda m: F.when(m["before"].rlike(f"(?:{AGAINST})"), -1).when(m["before"].rlike(f"(?:{CUES[kind]})"), 1).otherwise(0)
    edge = lambda m: F.when(m["before"].rlike(r"[\w.-]$") | m["after"].rlike(r"[\w@]"), -1).otherwise(1)
    shown = lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), _form(kind, m["x"]).alias("form"), _list(kind, m["x"]).cast("int").alias("list"), cue(m).alias("cue"), edge(m).alias("edge"))
    return F.when(guard, F.transform(placed_matches(text, kind), shown)).otherwise(F.array().cast("array<struct<kind:int,start:int,stop:int,form:int,list:int,cue:int,edge:int>>"))


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: all candidates of every row with their votes."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    flags = text.withColumn("at", t.contains("@")).withColumn("digit", t.rlike("[0-9]")).withColumn("titled", t.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b")).withColumn("spelled", t.contains("[at]") | t.contains("(at)"))
    guards = {"email": F.col("at"), "name": F.col("titled"), "spelled_email": F.col("spelled"), "phone": F.col("digit") & t.contains("+")}
    return flags.select("doc_id", F.concat(*(spans(t, k, guards.get(k, F.col("digit"))) for k in KINDS)).alias("spans"))


# ---- reliabilities and the classifier, from counts of vote patterns ----


#: Where expectation-maximisation starts: P(vote no, nothing, yes) by class.
START = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])


def fit_reliabilities(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of a two-class model with independent labelers: (posterior of each pattern, P(vote | class) over all kinds as [labeler, class, vote + 1]).

    A labeler has a reliability of its own for each kind, which a kind with few spans shares with all others: theirs count as 20 votes.
    """
    labelers = votes.shape[1]
    theta = np.tile(START, (labelers, 1, 1))
    own = np.tile(START, (labelers, len(KINDS), 1, 1))
    prior = np.full(len(KINDS), 0.7)
    q = np.full(len(n), 0.5)
    for _ in range(rounds):
        like = sum(np.log(own[j][kinds, :, votes[:, j] + 1]) for j in range(labelers))  # pattern x class
        odds = np.log(prior[kinds] / (1 - prior[kinds])) + like[:, 1] - like[:, 0]
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j in range(labelers):
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                # the start counts as 5 votes: labelers that hardly vote keep near it
                got = np.bincount(votes[:, j] + 1, w, 3) + 5 * START[c]
                theta[j][c] = got / got.sum()
                each = np.bincount(3 * kinds + votes[:, j] + 1, w, 3 * len(KINDS)).reshape(-1, 3) + 20 * theta[j][c]
                own[j][:, c] = each / each.sum(axis=1, keepdims=True)
        prior = np.clip((np.bincount(kinds, n * q, len(KINDS)) + 3.5) / (np.bincount(kinds, n, len(KINDS)) + 5), 0.02, 0.98)
    return q, theta


def fit_classifier(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, q: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic regression on kind and votes (each labeler's yes and no), fitted to soft labels by Newton steps with a ridge."""
    x = _features(kinds, votes)
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - q)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kinds], votes == 1, votes == -1], axis=1).astype(float)


def probability(span: Column, w: np.ndarray) -> Column:
    """The classifier as a Spark expression."""
    k = len(KINDS)
    z = F.get(F.array(*(F.lit(float(v)) for v in w[:k])), span["kind"])
    for j, name in enumerate(LABELERS):
        z = z + F.when(span[name] == 1, float(w[k + j])).when(span[name] == -1, float(w[k + len(LABELERS) + j])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, found (sorted structs start, kind, stop), base (those of the base kinds) of every row."""
    rows = staged(candidate_spans(docs), "candidates")
    s = F.col("s")
    patterns = rows.select(F.explode("spans").alias("s")).groupBy(s["kind"].alias("kind"), *(s[x].alias(x) for x in LABELERS)).agg(F.count(F.lit(1)).alias("n")).collect()  # 9 * 3**4 at most
    if patterns:
        kinds, n = np.array([r.kind for r in patterns]), np.array([r.n for r in patterns], float)
        votes = np.array([[r[x] for x in LABELERS] for r in patterns])
        q, _ = fit_reliabilities(kinds, votes, n)
        w = fit_classifier(kinds, votes, n, q)
    else:
        w = np.zeros(len(KINDS) + 2 * len(LABELERS))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    added = F.filter("spans", lambda x: (x["kind"] >= len(BASE)) & (probability(x, w) >= accept))
    put = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    outer = rows.select("doc_id", put(base).alias("base"), put(added).alias("added"))
    found = F.when(F.size("added") == 0, F.col("base")).otherwise(_without_overlaps(F.array_sort(F.concat("base", "added"))))
    return outer.select("doc_id", found.alias("found"), "base")


_SPAN = "struct<start:int,kind:int,stop:int>"


def _without_overlaps(items: Column) -> Column:
    """Sorted spans without the added ones that overlap a base span, and without those that overlap an added one that stays before them."""

    def backward(upto: Column, x: Column) -> tuple[Column, Column]:  # upto: the start of the next base span
        return F.when(x["kind"] < len(BASE), x["start"]).otherwise(upto), F.when((x["kind"] < len(BASE)) | (x["stop"] <= upto), x)

    def forward(upto: Column, x: Column) -> tuple[Column, Column]:  # upto: the ends of base spans, and of added ones, so far
        known, free = x["kind"] < len(BASE), (x["start"] >= upto["base"]) & (x["start"] >= upto["added"])
        stay = F.struct(F.when(known, F.greatest(upto["base"], x["stop"])).otherwise(upto["base"]).alias("base"), F.when(~known & free, x["stop"]).otherwise(upto["added"]).alias("added"))
        return stay, F.when(known | free, x)

    clear = _let(F.reverse(items), lambda r: _fold(r, F.size(r), F.lit(2**31 - 1), backward, _SPAN))
    zero = F.struct(F.lit(0).alias("base"), F.lit(0).alias("added"))
    return _let(F.reverse(clear), lambda r: _fold(r, F.size(r), zero, forward, _SPAN))


def _joined(c: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
