"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns give the certain spans.  High-recall generators then propose
further, overlapping candidates of the same four kinds: parts of runs that the
base patterns dropped as a whole, national and obfuscated spellings.  Boosted
trees score each candidate from its format and its context, a threshold for each
kind, calibrated on labelled candidates kept from training, selects, and of
overlapping ones the highest score stays.  Base spans always stay.

The trees are fitted on ``LABELLED`` generated candidates (a fixed number) by
numpy on the driver and become column expressions; texts are only handled by
built-in functions.  A row's spans depend on that row alone: no shuffle.

Results for unusual input: null and empty texts have no spans; offsets count
code points; long runs of digits or address characters cost time in proportion
(patterns are possessive); repeated rows are judged row by row; an empty table
gives an empty result.  Extra columns with any name are ignored, or kept by
``redact``.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Number of generated labelled candidates, trees, learning rate, and the precision that thresholds must reach.
LABELLED, TREES, RATE, PRECISION = 800, 24, 0.4, 0.995

_LOCAL = "A-Za-z0-9._%+-"
#: Base patterns.  Possessive forms match the same strings as the greedy ones and need no backtracking.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
GENERATORS = {
    "email": [
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,4}+",
    ],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"],
    "card": [
        r"(?<![0-9])[0-9]{14,16}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{5}(?![0-9])",
    ],
    "phone": [
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9+])\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])(?![.-][0-9])",
    ],
}
#: What a text must hold for a kind's patterns to be tried at all.
_MAY_HOLD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

_SPELT = r"(?i)[\[({]at[\])}]|\x20at\x20[a-z0-9-]++\x20dot\x20"
_SPAN = "struct<s:int,e:int,t:string>"


def _spans(text: Column, pattern: str) -> Column:
    """(s, e, t) of each leftmost non-overlapping match: matches and the gaps between them alternate."""

    def placed(w: Column) -> Column:
        return F.zip_with(w["m"], F.slice(w["g"], 1, F.size(w["m"])), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))

    def located(steps: Column) -> Column:
        before = _scan(steps, lambda x: x["g"] + x["n"], lambda a, b: a + b, "int")
        start = lambda x, at: F.coalesce(at, F.lit(0)) + x["g"]
        return F.zip_with(steps, before, lambda x, at: F.struct(start(x, at).alias("s"), (start(x, at) + x["n"]).alias("e"), x["m"].alias("t")).cast(_SPAN))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.transform(F.transform(F.array(found), placed), located)[0]


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""

    def add(total, i):
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _holds(kind: str, t: Column) -> Column:
    """What a base match must satisfy besides its pattern."""
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("000")), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(t)).between(14, 19) & luhn(F.left(_digits(t), F.lit(19)))
    if kind == "phone":
        return F.length(_digits(t)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    may = text.contains("@") if kind == "email" else text.contains("+") & text.rlike("[0-9]") if kind == "phone" else text.rlike(_MAY_HOLD[kind])
    return F.when(may, F.filter(_spans(text, BASE[kind]), lambda x: _holds(kind, x["t"]))).otherwise(none)


def candidates(text: Column, kind: str) -> Column:
    """(s, e, t, before, after) proposed by the generators, overlapping and repeated."""
    none = F.array().cast("array<struct<s:int,e:int,t:string,before:string,after:string>>")
    near = lambda x: F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        x["t"].alias("t"),
        F.lower(F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))).alias("before"),
        F.substring(text, x["e"] + 1, F.lit(1)).alias("after"),
    )
    found = F.concat(*[F.transform(_spans(text, p), near) for p in GENERATORS[kind]])
    may = text.rlike(_SPELT) if kind == "email" else text.rlike(_MAY_HOLD[kind])
    return F.when(may, found).otherwise(none)


#: Context words, as prefixes of a word.
_WORDS = {
    "card": "card|visa|master|credit|debit|amex|pay|kredit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil|cell|whatsapp|contact|appel|llam",
    "ip": "ip|addr|host|server|login|client|from",
    "email": "mail|contact|write|send|reach|schreib|ecri|escrib",
    "other": "order|invoice|serial|ref|isbn|version|ver|page|section|sku|part|build|release|item|uuid|token|hash|tracking|id|room|score",
}


def features(kind: str, c: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    t, before = c["t"], c["before"]
    number = lambda b: F.when(b, 1.0).otherwise(0.0)
    d = _digits(t)
    word = lambda k: number(before.rlike(rf"(?:^|[^a-z])(?:{_WORDS[k]})[a-z]*[^a-z]*$|(?:^|[^a-z])(?:{_WORDS[k]})[a-z]*[^a-z]+[a-z]+[^a-z]*$"))
    parts = F.split(t, r"\.")
    return [
        F.length(d).cast("double"),
        number((F.length(d) >= 13) & luhn(F.left(d, F.lit(19)))),
        F.when(F.length(d) > 0, F.ascii(d) - 48).otherwise(-1).cast("double"),
        F.length(F.regexp_replace(t, "[^\\x20.()-]", "")).cast("double"),
        number(t.startswith("+")),
        number(F.forall(parts, lambda p: (F.length(p) <= 3) & p.rlike("^(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        number(t.rlike(r"(?i)[\[({](?:at|dot)[\])}]")),
        number(t.rlike(r"(?i)\.[a-z]{2,6}$|dot[\])}]?\x20?[a-z]{2,6}$")),
        word(kind),
        word("other"),
        number(before.rlike("[a-z0-9#_/.-]$")),
        number(c["after"].rlike("[A-Za-z0-9_/-]")),
    ]


def _generated() -> list[tuple[str, str, int]]:
    """(kind, text, whether its candidate is personal data), the same on every run."""
    r = random.Random(20240501)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeionrstlmd") for _ in range(r.randint(2, 8)))

    def check(digits: str) -> str:
        total = 0
        for i, x in enumerate(reversed(digits)):
            v = int(x) * (2 if i % 2 == 0 else 1)
            total += v - 9 if v > 9 else v
        return digits + str(-total % 10)

    def spaced(s: str) -> str:
        sep = r.choice(["", "", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def wrong(s: str) -> str:
        return s[:-1] + str((int(s[-1]) + r.randint(1, 9)) % 10)

    rows = []
    while len(rows) < LABELLED:
        kind = r.choice(KINDS)
        good = r.random() < 0.5
        mine = _WORDS[kind].split("|")
        lead = r.choice([w(), w(), r.choice(mine), r.choice(mine) + " " + w(), n(3)] if good else [w(), r.choice(_WORDS["other"].split("|")), r.choice(_WORDS["other"].split("|")) + " no."])
        if kind == "card":
            number = check(r.choice("3456") + n(14))
            t = spaced(number if good else wrong(number))
        elif kind == "ip":
            t = ".".join(str(r.randint(1, 255)) for _ in range(4)) if good else ".".join(r.choice([n(1), n(2), "0" + n(2), str(r.randint(256, 999))]) for _ in range(4))
            if not good and all(p == str(int(p)) and int(p) < 256 for p in t.split(".")):
                lead = r.choice(["version", "section", "release", "build", "ver"])
        elif kind == "phone":
            a, b, c = r.choice("23456789") + n(2), n(3), n(4)
            if good:
                t = r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}"])
                if r.random() < 0.3:
                    lead, t = r.choice(mine), f"{a}-{b}-{c}"
            else:
                lead, t = r.choice(_WORDS["other"].split("|")), f"{a}{r.choice('.-')}{b}{r.choice('.-')}{c}"
        else:
            if good:
                at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", ".")])
                t = f"{w()}{r.choice(['', '.' + w()])}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
            else:
                t = r.choice([f"{w()} at {w()} dot {w()}{n(1)}", f"{w()} (at) {w()}. {w()}"])
        rows.append((kind, f"{w()} {lead} {t} {r.choice([w(), n(2) if good and kind != 'ip' else w()])}", int(good)))
    return rows


def _boost(x: np.ndarray, y: np.ndarray, trees: int, rate: float) -> tuple[float, list]:
    """Logistic gradient boosting with trees of depth 2: (start, [(split, split, split, four values)])."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, out = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(c, np.linspace(0.05, 0.95, 15))) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def split(rows):
            best = (1e-9, 0, np.inf)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f, values in enumerate(cuts):
                for v in values:
                    low = rows & (x[:, f] <= v)
                    high = rows & ~low
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                    if gain > best[0]:
                        best = (gain, f, float(v))
            return best[1], best[2]

        top = split(np.ones(len(y), bool))
        low = x[:, top[0]] <= top[1]
        left, right = split(low), split(~low)
        leaves = [low & (x[:, left[0]] <= left[1]), low & (x[:, left[0]] > left[1]), ~low & (x[:, right[0]] <= right[1]), ~low & (x[:, right[0]] > right[1])]
        values = [float(rate * g[k].sum() / (h[k].sum() + 1)) for k in leaves]
        for k, v in zip(leaves, values):
            score[k] += v
        out.append((top, left, right, values))
    return start, out


def _score(model, f: list):
    """Sum of the trees' values, for column expressions."""
    start, trees = model
    total = F.lit(start)
    for top, left, right, v in trees:
        part = lambda s, a, b: F.when(f[s[0]] <= s[1], a).otherwise(b) if np.isfinite(s[1]) else F.lit(a)
        low, high = part(left, v[0], v[1]), part(right, v[2], v[3])
        total = total + (F.when(f[top[0]] <= top[1], low).otherwise(high) if np.isfinite(top[1]) else low)
    return total


def _apply(model, x: np.ndarray) -> np.ndarray:
    start, trees = model
    out = np.full(len(x), start)
    for top, left, right, v in trees:
        low = x[:, top[0]] <= top[1]
        out += np.where(low, np.where(x[:, left[0]] <= left[1], v[0], v[1]), np.where(x[:, right[0]] <= right[1], v[2], v[3]))
    return out


_MODELS: dict = {}


def models(spark: SparkSession) -> dict[str, tuple]:
    """kind -> (trees, threshold), fitted once per driver on the generated candidates."""
    if _MODELS:
        return _MODELS
    rows = _generated()
    literal = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text"), F.lit(y).alias("y")) for k, t, y in rows])
    table = spark.range(1).select(F.explode(literal).alias("r")).select("r.*")
    for kind in KINDS:
        own = table.where(F.col("kind") == kind)
        found = own.select("text", "y", F.explode(candidates(F.col("text"), kind)).alias("c")).select("text", "y", F.array(*features(kind, F.col("c"))).alias("f"))
        got = sorted((r["text"], r["y"], r["f"]) for r in found.collect())
        x, y = np.array([g[2] for g in got]), np.array([g[1] for g in got], float)
        held = np.arange(len(y)) % 4 == 3
        model = _boost(x[~held], y[~held], TREES, RATE)
        s, t = _apply(model, x[held]), y[held]
        limits = [v for v in np.unique(s) if t[s >= v].mean() >= PRECISION]
        _MODELS[kind] = (model, float(min(limits)) - 1e-9 if limits else float("inf"))
    return _MODELS


_ALL = "array<struct<s:int,k:int,e:int>>"


def _scan(rows: Column, value, merge, kind: str) -> Column:
    """For each element the merge of the values of all before it (null at the first).

    In blocks of about the root of the length: running values inside a block are
    appended to a short array, so long arrays cost less than their square.
    """
    width = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(rows)))).cast("int")
    none = F.array().cast(f"array<{kind}>")
    joined = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b))
    empty = F.lit(None).cast(kind)

    def running(items: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), joined(acc["at"], v).cast(kind).alias("at"))
        return F.aggregate(items, F.struct(none.alias("out"), start.alias("at")), step, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / width).cast("int")), lambda k: F.transform(F.slice(rows, k * width + 1, width), value))
    whole = F.transform(F.array(blocks), lambda bs: F.zip_with(bs, running(F.transform(bs, lambda b: F.aggregate(b, empty, lambda a, v: joined(a, v).cast(kind))), empty), running))[0]
    return F.when(F.size(rows) > 0, F.flatten(whole)).otherwise(none)


def with_spans(docs: DataFrame, base_name: str, spans_name: str, text: str = "text") -> DataFrame:
    """Append two columns: arrays of (s, k, e) by start and kind, of the base spans and of all."""
    fitted = models(docs.sparkSession)
    t = text_or_empty(text)
    base = {k: base_spans(t, k) for k in KINDS}
    place = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"))
    may = t.rlike("[0-9@]|" + _SPELT)
    none = F.array().cast(_ALL)
    out = docs.withColumn(base_name, F.when(may, F.array_sort(F.concat(*[F.transform(base[k], place(k)) for k in KINDS]))).otherwise(none).cast(_ALL))
    offered = "array<struct<s:int,score:double,k:int,e:int>>"

    def chosen(kind):
        model, limit = fitted[kind]
        if not np.isfinite(limit):
            return F.array().cast(offered)
        scored = F.transform(
            candidates(t, kind),
            lambda c: F.struct(c["s"].alias("s"), (-_score(model, features(kind, c))).alias("score"), F.lit(KINDS.index(kind)).alias("k"), c["e"].alias("e")),
        )
        return F.filter(scored, lambda c: c["score"] <= -limit)

    apart = lambda spans, c: ~F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    sure = F.transform(base_name, lambda b: F.struct(b["s"].alias("s"), F.lit(-1e9).alias("score"), b["k"].alias("k"), b["e"].alias("e")))
    both = F.array_sort(F.concat(sure.cast(offered), *[chosen(k) for k in KINDS]))

    def select(cluster: Column) -> Column:
        """Base spans, then the highest scores that overlap nothing chosen."""
        by_score = F.array_sort(F.transform(cluster, lambda c: F.struct(c["score"].alias("score"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
        take = lambda acc, c: F.when((c["score"] == -1e9) | apart(acc, c), F.concat(acc, F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))).cast(_ALL))).otherwise(acc)
        return F.aggregate(by_score, none, take)

    def clusters(rows: Column) -> Column:
        """Runs of overlapping spans: a span that starts at or behind every earlier end opens one."""
        ends = _scan(rows, lambda x: x["e"], F.greatest, "int")
        opens = F.filter(F.transform(F.arrays_zip(rows.alias("r"), ends.alias("end")), lambda z, i: F.when(z["end"].isNull() | (z["r"]["s"] >= z["end"]), i)), lambda i: i.isNotNull())
        return F.transform(F.array(opens), lambda at: F.transform(at, lambda i, n: F.slice(rows, i + 1, F.coalesce(F.get(at, n + 1), F.size(rows)) - i)))[0]

    added = F.transform(F.array(both), lambda rows: F.flatten(F.transform(clusters(rows), select)))[0]
    return out.withColumn(spans_name, F.when(may, F.array_sort(added)).otherwise(none))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans of every whole text."""
    found = with_spans(docs.select("doc_id", "text"), "base", "spans")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows where it exists."""
    base, spans, clean = fresh_names(docs, "base", "spans", "clean")
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col("text")

    def pieces(rows: Column) -> Column:
        """The text up to each span and its kind, and the rest; a span inside earlier ones adds nothing."""
        ends = F.transform(_scan(rows, lambda x: x["e"], F.greatest, "int"), lambda e: F.coalesce(e, F.lit(0)))
        each = F.transform(
            F.arrays_zip(rows.alias("x"), ends.alias("at")),
            lambda z: F.when(z["x"]["e"] <= z["at"], F.lit("")).otherwise(F.concat(F.substring(t, z["at"] + 1, F.greatest(z["x"]["s"] - z["at"], F.lit(0))), F.get(name, z["x"]["k"]))),
        )
        return F.concat(F.array_join(each, ""), F.substring(t, F.array_max(F.transform(rows, lambda x: x["e"])) + 1, F.length(t)))

    folded = F.transform(F.array(F.col(spans)), pieces)[0]
    found = with_spans(docs, base, spans).withColumn(clean, F.when(F.size(spans) > 0, folded).otherwise(t))
    new = {"text": F.col(clean).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
