"""Personal data by weak supervision, with DataFrame operations only.

Candidates are matches of a pattern per kind (e-mail address, IP address, payment card, phone number), strict or
loose, of all four kinds. Four labelers vote on each (-1, 0 or 1): the strict pattern with its checks (0 for a loose
match), a gazetteer (domain ends, address blocks, issuers' numbers, calling codes), the words before, and the characters around. Votes are counted over the whole corpus by pattern, which gives a table of
bounded size (kinds x 3**4 votes x length classes); expectation maximisation on those counts estimates how
reliable each labeler is for each kind, and its posteriors are the soft labels of a logistic classifier of
spans, which is again a SQL expression. Strict matches always stay; the classifier adds others.

Patterns use possessive repeats and start at run borders, so a long run of one character class costs one pass.
Positions are in code points. They are running sums of the lengths of matches and of the text between
them; the sums go over blocks of matches, so very many matches in one text stay affordable.

Defined results: null counts as an empty text; repeated rows each get their own row; an empty table gives an empty result; other
columns stay as they are, but for names that begin with one of OWN_COLUMNS, which are an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The strict patterns and the numbers of digits.
_STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CARD_DIGITS, _PHONE_DIGITS = (13, 19), (9, 15)

# Loose patterns, gazetteers and cue words.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:\.|dot|DOT)[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_DOMAIN_ENDS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl|be|mx|ar|br"
_CARD_STARTS = "4|5[1-5]|2[2-7]|3[4578]|6[05]|62"
#: country calling codes of one, two and three digits
_CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6][0-9]|29[017-9]|35[0-9]|37[0-8]|38[0-25-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-9]|69[0-2]|85[0235-6]|88[06]|96[0-8]|97[0-79]|99[2-68]"
_CUES = {
    "email": "mail|contact|write|reach|schreib|correo|courriel",
    "ip": "ip|host|server|address|adresse|direcci",
    "card": "card|visa|credit|karte|tarjeta|carte|pay",
    "phone": "phone|tel|call|fax|mobile|ruf|appel|llam",
}
_AGAINST = "token|key|sha|hash|version|isbn|issn|serial|http"
_CONTEXT = 24
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array of longs, two-level so that the work stays near linear."""

    def scan(block: Column, base: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            block,
            F.struct(base.alias("total"), none.alias("out")),
            lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"] + x)).alias("out")),
            lambda s: s["out"],
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    bases = F.concat(F.array(zero), scan(totals, zero))
    return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), scan))


_SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def locate(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, end (exclusive), value, and a little of the text around."""
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda b, v: (F.length(b) + F.length(v)).cast("bigint"))
    sides = F.zip_with(F.slice(between, 1, F.size(values)), F.slice(between, 2, F.size(values)), lambda a, b: F.struct(F.right(a, F.lit(_CONTEXT)).alias("left"), F.substring(b, 1, 1).alias("right")))
    ends = F.zip_with(_running(lengths), values, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
    both = F.zip_with(ends, sides, lambda a, b: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["value"].alias("value"), b["left"].alias("left"), b["right"].alias("right")))
    return F.when(F.size(values) > 0, both).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of at most 19 digits."""

    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    digits = _digits(value)
    low, high = _CARD_DIGITS if kind == "card" else _PHONE_DIGITS
    fits = F.length(digits).between(low, high)
    return fits & F.when(fits, luhn(digits)).otherwise(False) if kind == "card" else fits


def _present(kind: str, text: Column) -> Column:
    """A cheap test that every text with a strict match passes."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def _loosely_present(kind: str, text: Column) -> Column:
    tests = {"email": r"[\[(](?:at|AT)[\])]", "ip": r"[0-9]\x20?[\[(](?:\.|dot|DOT)[\])]", "card": "[0-9]{4}[./_][0-9]{4}[./_]", "phone": r"[0-9][\x20.-][0-9]{4}"}
    return text.rlike(tests[kind])


_CANDIDATE = "array<struct<start:bigint,end:bigint,strict:int,regex:int,gazetteer:int,context:int,shape:int,size:int>>"


def _voted(kind: str, spans: Column, strict: bool) -> Column:
    """Add the votes of the labelers to the spans of a kind."""

    def vote(x: Column) -> Column:
        value, digits = x["value"], _digits(x["value"])
        ok = _valid(kind, value) if strict else F.lit(False)
        if kind == "email":
            gazetteer = F.when(F.lower(value).rlike(rf"(?:\.|dot[\])]\x20?)(?:{_DOMAIN_ENDS})$"), 1).otherwise(-1)
        elif kind == "ip":
            parts = F.transform(F.split(value, "[^0-9]+"), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))
            # blocks that hosts can have: neither 0 nor multicast nor beyond
            gazetteer = F.when(parts[0].between(1, 223) & F.forall(parts, lambda p: p <= 255), 1).otherwise(-1)
        elif kind == "card":
            gazetteer = F.when(digits.rlike(f"^(?:{_CARD_STARTS})"), 1).otherwise(-1)
        else:
            # with a plus sign a calling code, without one an area code of ten digits, which never starts with 0 or 1
            known = F.when(value.startswith("+"), digits.rlike(f"^(?:{_CALLING_CODES})")).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9]"))
            gazetteer = F.when(known, 1).otherwise(-1)
        left = F.lower(x["left"])
        context = F.when(left.rlike(_AGAINST), -1).when(left.rlike(rf"(?:^|[^a-z])(?:{_CUES[kind]})"), 1).otherwise(0)
        inside = x["left"].rlike("[A-Za-z0-9_]$") | x["right"].rlike("^[A-Za-z0-9_]")
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            ok.cast("int").alias("strict"),
            (F.when(ok, 1).otherwise(-1) if strict else F.lit(0)).alias("regex"),
            gazetteer.alias("gazetteer"),
            context.alias("context"),
            F.when(inside, -1).otherwise(1).alias("shape"),
            F.least(F.length(value) / 8, F.lit(3)).cast("int").alias("size"),
        )

    return F.transform(spans, vote).cast(_CANDIDATE)


def _apart_from(others: Column) -> Callable[[Column], Column]:
    return lambda x: ~F.exists(others, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))


OWN_COLUMNS = ("_email", "_ip", "_card", "_phone", "_cut", "base_spans", "all_spans")


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a column per kind with its candidates and their votes, strict matches and loose ones, by start."""
    col, none = F.coalesce(F.col(text), F.lit("")), F.array().cast(_CANDIDATE)
    out = docs
    for kind in KINDS:
        found = locate(col, _STRICT[kind])
        if kind in ("card", "phone"):  # a match of few digits can be neither
            found = F.filter(found, lambda x: F.length(_digits(x["value"])) >= 9)
        out = out.withColumn(f"_{kind}", F.when(_present(kind, col), _voted(kind, found, True)).otherwise(none))
    for kind in _LOOSE:
        loose = _voted(kind, locate(col, _LOOSE[kind]), False)
        strict = F.filter(F.concat(*[F.col(f"_{k}") for k in KINDS]), lambda y: y["strict"] == 1)
        free = F.filter(loose, _apart_from(strict))
        out = out.withColumn(f"_{kind}_loose", F.when(_loosely_present(kind, col), free).otherwise(none))
    for kind in _LOOSE:
        by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]).cast("int")
        merged = F.when(F.size(f"_{kind}_loose") > 0, F.array_sort(F.concat(f"_{kind}", f"_{kind}_loose"), by_start)).otherwise(F.col(f"_{kind}"))
        out = out.withColumn(f"_{kind}", merged).drop(f"_{kind}_loose")
    return out


VOTERS = ("regex", "gazetteer", "context", "shape")


@dataclass
class SpanModel:
    """Weights of the span classifier by feature, and the labelers' estimated reliabilities."""

    weights: dict[tuple[str, str, int], float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    #: (kind, labeler) to the chance that a vote that is not 0 is right
    reliability: dict[tuple[str, str], float] = field(default_factory=dict)

    def accepts(self, kind: str, x: Column) -> Column:
        if kind not in self.bias:
            return F.lit(False)
        score = F.lit(self.bias[kind])
        for (k, name, value), w in sorted(self.weights.items()):
            if k == kind:
                score = score + F.when(x[name] == value, w).otherwise(0.0)
        return score > 0


def vote_counts(candidates: DataFrame) -> DataFrame:
    """How often each pattern of votes occurs, by kind: at most kinds x 81 x 4 rows."""
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), *[x[v].alias(v) for v in (*VOTERS, "size")])
    each = F.concat(*[F.transform(F.col(f"_{k}"), named(k)) for k in KINDS])
    return candidates.where(" or ".join(f"size(_{k}) > 0" for k in KINDS)).select(F.inline(each)).groupBy("kind", *VOTERS, "size").count()


def fit(counts: list, rounds: int = 50, steps: int = 400) -> SpanModel:
    """EM over the counted vote patterns of each kind, then a logistic classifier on the posteriors."""
    model = SpanModel()
    for kind in KINDS:
        rows = sorted((r for r in counts if r["kind"] == kind), key=lambda r: tuple(r[v] for v in (*VOTERS, "size")))
        if not rows:
            continue
        votes = np.array([[r[v] for v in VOTERS] for r in rows])
        n = np.array([r["count"] for r in rows], float)
        p = 1 / (1 + np.exp(-votes.sum(1).astype(float)))  # start from the vote's balance
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            log_odds = np.full(len(rows), np.log(prior / (1 - prior)))
            for j in range(len(VOTERS)):
                for value in (-1, 0, 1):
                    has = votes[:, j] == value
                    good = (n[has] @ p[has] + 1) / (n @ p + 3)
                    bad = (n[has] @ (1 - p[has]) + 1) / (n @ (1 - p) + 3)
                    log_odds[has] += np.log(good / bad)
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        for j, name in enumerate(VOTERS):
            right = n[votes[:, j] == 1] @ p[votes[:, j] == 1] + n[votes[:, j] == -1] @ (1 - p[votes[:, j] == -1])
            model.reliability[kind, name] = float((right + 1) / (n[votes[:, j] != 0].sum() + 2))
        names = [(v, value) for v in VOTERS for value in (-1, 0, 1)] + [("size", s) for s in range(4)]
        x = np.array([[float(r[v] == value) for v, value in names] for r in rows])
        w, b, weight = np.zeros(len(names)), 0.0, n / n.sum()
        for _ in range(steps):
            grad = weight * (1 / (1 + np.exp(-(x @ w + b))) - p)
            w -= 2.0 * (x.T @ grad + 1e-4 * w)
            b -= 2.0 * grad.sum()
        model.bias[kind] = float(b)
        model.weights |= {(kind, v, value): float(wi) for (v, value), wi in zip(names, w, strict=True) if wi}
    return model


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and all_spans to every row: arrays of (kind, start, end), by kind as in KINDS, then by start."""
    if clash := [c for c in docs.columns if c.startswith(OWN_COLUMNS)]:
        raise ValueError(f"columns {clash} have names of results")
    candidates = with_candidates(docs, text)
    model = fit(vote_counts(with_candidates(docs.select(text), text)).collect())

    def spans(wanted: Callable[[str], Callable[[Column], Column]]) -> Column:
        named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        return F.concat(*[F.transform(F.filter(F.col(f"_{k}"), wanted(k)), named(k)) for k in KINDS])

    base = spans(lambda _: lambda x: x["strict"] == 1)
    every = spans(lambda k: lambda x: (x["strict"] == 1) | ((x["regex"] == 0) & model.accepts(k, x)))
    return candidates.withColumn("base_spans", base).withColumn("all_spans", every).drop(*[f"_{k}" for k in KINDS])


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the strict spans and the list of all spans, per document."""
    found = detect(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets. Spans that overlap are replaced together, under the first one's kind."""
    found = detect(docs, text)
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]).cast("int")
    one = "array<struct<kind:string,start:bigint,end:bigint>>"

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(acc) == 0) | (F.when(F.size(acc) > 0, last["end"]).otherwise(F.lit(-1)) <= x["start"])
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).cast(one)

    found = found.withColumn("_cut", F.aggregate(F.array_sort("all_spans", by_start).cast(one), F.array().cast(one), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(join(acc, x)).cast(one)))
    col = F.col(text)
    befores = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cut", lambda x: x["end"]))
    kept = F.zip_with(F.slice(befores, 1, F.size("_cut")), "_cut", lambda b, x: F.concat(F.substring(col, (b + 1).cast("int"), (x["start"] - b).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    tail = F.substring(col, (F.element_at(befores, -1) + 1).cast("int"), F.length(col))
    clean = F.when(F.size("_cut") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(col)
    return found.withColumn(text, clean).drop("_cut", "base_spans", "all_spans")
