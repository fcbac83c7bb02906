"""Personal data: weak-supervision aggregation, in DataFrame operations alone.

Every text gives candidate spans of four kinds. Five labelers vote on each: the rule (the strict one, or on other forms
the same on what they stand for), a format regex, a gazetteer (top-level domains, card issuers, country codes, address ranges), the words
around it, and its borders. Expectation-maximisation over the counts of vote patterns estimates each
labeler's hit and false-alarm rate by kind without any label (Dawid and Skene 1979); the patterns'
posteriors then train a logistic span classifier on the span's own features. A candidate is reported if
the strict rule holds (such spans always stay) or the classifier gives it 0.5 or more and it doesn't
overlap a strict one.

Only counts by (kind, votes, features) reach the driver: at most 4 * 2^5 * 2^7 rows, whatever the
input. Texts are read once; candidates are staged, for mask() with the rows that it returns. Folds over a text's spans
run in runs of at most RUN, so the work on a text follows its length and its number of spans.

Defined results: null and empty texts have no span; offsets are code points, end exclusive; a
repeated doc_id is treated row by row; an empty table trains a classifier that adds nothing. Extra
columns are ignored by spans() and kept by mask().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Look-behinds and possessive loops keep Java's matcher linear and don't change a match:
# a match can only begin where a run of its first class begins, or where the match before ended (\G).
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: written-out addresses and those with other letters, addresses with guarded dots or of version 6, card
#: numbers with other marks between their groups, and numbers without a plus sign as several countries write them.
_AT, _DOT = r"(?: at | ?\(at\) ?| ?\[at\] ?)", r"(?: dot | ?\(dot\) ?| ?\[dot\] ?)"
_GUARDED = r"(?: ?\[\.\] ?| ?\(\.\) ?| ?\[dot\] ?| ?\(dot\) ?)"
_HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"
    r"|(?<![\p{L}\p{N}._%+-])(?=[A-Za-z0-9._%+@-]{0,120}+[^\x00-\x7F])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_GUARDED}[0-9]{{1,3}}){{3}}(?![0-9])"
    rf"|(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9./_])(?:[0-9]{4}(?:[./_][0-9]{4}){3}|[0-9]{4}[./_][0-9]{6}[./_][0-9]{5})(?![0-9./_])",
    "phone": r"(?<![0-9A-Za-z+.])(?:(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|0[1-9](?:[ .-][0-9]{2}){4}|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|0[0-9]{2}[ -][0-9]{4}[ -][0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{6,8})(?![0-9A-Za-z])",
}
FORMAT = {
    "email": r"^[\p{L}\p{N}][\p{L}\p{N}._%+-]*@([\p{L}\p{N}][\p{L}\p{N}-]*\.)+\p{L}{2,}$",
    "ip": rf"^(0|[1-9][0-9]{{0,2}})(\.(0|[1-9][0-9]{{0,2}})){{3}}$|^{_HEX}(:{_HEX}){{7}}$|^(?=.*[0-9])(?=(?:[^:]*:){{3}})(?!(?:[^:]*:){{8}}){_HEX}(:{_HEX})*::{_HEX}(:{_HEX})*$",
    "card": r"^([0-9]{14,16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$",
    "phone": r"^(\+[0-9]{1,3}|00[0-9]{1,3})?[ .-]?(\([0-9]{2,4}\)|[0-9]{2,5})([ ./-]?[0-9]{2,8}){1,4}$",
}
GAZETTEER = {
    "email": r"(?i)[. ]([a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|shop|site|store|tech|blog|email|xyz)$",
    "ip": r"^(?!0\.|127\.|255\.)[0-9.]+$|(?i)^(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|65|35)",
    "phone": r"^(\+|00)(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^0[1-9]|^\(?[2-9][0-9]{2}\)? ?[0-9]{3}[ .-][0-9]{4}$",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|from|to|an|a|por|pour)\W*$",
    "ip": r"(?i)\b(ip|host|server|address|adresse|client|from)\W*$",
    "card": r"(?i)\b(card|visa|karte|carte|tarjeta|credit|amex|number|nr|no)\W*$",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\W*$",
}
#: Characters before a span that a context labeler sees; spans of a text that one fold takes.
AROUND, RUN = 24, 64
THRESHOLD = 0.5
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
_FOUND = "array<struct<kind:string,start:int,end:int,strict:boolean,votes:int,features:int>>"
LABELERS, FEATURES = 5, 7


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: what stands inside a lambda is computed anew for every element."""
    return F.transform(F.array(value), f)[0]


def _parts(a: Column) -> Column:
    """An array cut into runs of at most RUN elements: folds that append copy what they have, so they're kept short."""
    return _let(a, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))), lambda i: F.slice(v, i * RUN + 1, F.lit(RUN))))


def matches(text: Column, pattern: str) -> Column:
    """array<start, end, value, before, after> of a pattern's leftmost non-overlapping matches, in code points.

    before and after are the text around as far as the matches on either side, AROUND characters and one at most. All
    come from one split of the text: finding a place in a text by its number costs as much as the text is long.
    """
    state = f"struct<at:int,out:array<{_SPAN}>>"
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    nothing = F.array(F.lit(""))
    around = F.zip_with(F.concat(nothing, values), gaps, lambda v, gap: F.struct(F.length(gap).alias("gap"), F.right(F.concat(v, F.right(gap, F.lit(AROUND))), F.lit(AROUND)).alias("before"), F.substring(gap, 1, 1).alias("first")))
    parts = _let(around, lambda a: F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), lambda g, h: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), h["first"].alias("after"))))
    parts = F.zip_with(parts, values, lambda g, v: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), v.alias("value"), g["after"].alias("after")))
    parts = F.filter(parts, lambda x: x["value"].isNotNull())
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), F.coalesce(x["after"], F.lit("")).alias("after"))).alias("out")).cast(state)

    def joined(acc: Column, run: Column) -> Column:
        """Runs one after another, each moved to where it begins."""
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out")).cast(f"struct<at:int,out:array<array<{_SPAN}>>>")

    runs = F.transform(_parts(parts), lambda run: F.aggregate(run, begin, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")).cast(f"struct<at:int,out:array<array<{_SPAN}>>>")
    found = F.aggregate(runs, none, joined, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def running_max(a: Column) -> Column:
    """The largest element up to and with each one, of an array of int."""
    inside = F.transform(_parts(a), lambda run: F.aggregate(run, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.greatest(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), x)))))
    state = "struct<top:int,out:array<array<int>>>"
    begin = F.struct(F.lit(-(1 << 31)).alias("top"), F.array().cast("array<array<int>>").alias("out")).cast(state)

    def joined(acc: Column, run: Column) -> Column:
        return F.struct(F.greatest(acc["top"], F.coalesce(F.try_element_at(run, F.lit(-1)), acc["top"])).alias("top"), F.array_append(acc["out"], F.transform(run, lambda x: F.greatest(x, acc["top"]))).alias("out")).cast(state)

    return F.aggregate(inside, begin, joined, lambda acc: F.flatten(acc["out"]))


def holds(kind: str, value: Column) -> Column:
    """The strict rule beyond the pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _bits(*flags: Column) -> Column:
    out = F.lit(0)
    for k, flag in enumerate(flags):
        out = out + F.when(flag, 1 << k).otherwise(0)
    return out.cast("int")


#: How a candidate's marks are put into the form that the rules are about.
PLAIN = {"email": ((_AT, "@"), (_DOT, ".")), "ip": ((_GUARDED, "."),), "card": (("[./_]", " "),), "phone": ()}
#: Written-out forms that prose can hold by chance: "met at noon dot com".
_PROSE = r" at | dot "


def _told(kind: str, x: Column, strict: Column | None) -> Column:
    """A candidate with its votes and features; strict: of one found by the strict pattern, whether its rule holds."""
    v, before, after, kind_no = x["value"], x["before"], x["after"], KINDS.index(kind)
    prose = v.rlike(_PROSE)
    for mark, plain in PLAIN[kind]:  # judged as what they stand for
        v = F.regexp_replace(v, mark, plain)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    formed, listed, told = v.rlike(FORMAT[kind]), F.regexp_replace(v, "^[ (]+", "").rlike(GAZETTEER[kind]), before.rlike(CONTEXT[kind])
    if strict is not None:
        rule = strict
    elif kind == "phone":  # three groups of digits alone are also sums
        rule = v.rlike(r"^[0(]") & digits.between(9, 15)
    elif kind == "ip":
        rule = formed & (v.contains(":") | holds("ip", v))
    else:
        rule = formed & ~prose & holds(kind, v)
    borders = ~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"[\p{L}\p{N}_]")
    votes = _bits(rule, formed, listed, told, borders)
    features = _bits(F.length(v) >= F.lit((12, 9, 15, 11)[kind_no]), digits >= F.lit((3, 7, 14, 10)[kind_no]), formed, v.contains(" "), borders & ~before.rlike(r"[.,:;@/=\"#-]$"), told, rule)
    base = F.lit(False) if strict is None else strict
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("strict"), votes.alias("votes"), features.alias("features"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, with votes and features."""
    empty = F.array().cast(_FOUND)

    def told(kind: str, pattern: str, strict: bool) -> Column:
        found = matches(text, pattern)
        if strict and kind == "card":  # shorter numbers are no candidates
            found = F.filter(found, lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 12)
        return F.transform(found, lambda x: _told(kind, x, holds(kind, x["value"]) if strict else None)).cast(_FOUND)

    out = [told(k, p, True) for k, p in STRICT.items()] + [told(k, p, False) for k, p in LOOSE.items()]
    return F.when(text.rlike("[0-9@]| at |[(\\[]at[)\\]]|::|[A-Fa-f]:"), F.concat(*out)).otherwise(empty)


# ---- the model: plain arithmetic over the bounded table of patterns ----

Pattern = tuple[str, int, int, int]  # kind, votes, features, count


def posteriors(patterns: list[Pattern], rounds: int = 30) -> tuple[dict[tuple[str, int], float], dict[tuple[str, int], tuple[float, float]]]:
    """EM by kind: the probability of each vote pattern, and each labeler's hit and false-alarm rate."""
    out: dict[tuple[str, int], float] = {}
    rates: dict[tuple[str, int], tuple[float, float]] = {}
    for kind in KINDS:
        counts: dict[int, float] = {}
        for k, votes, _, n in patterns:
            if k == kind:
                counts[votes] = counts.get(votes, 0.0) + n
        q = {v: min(0.95, max(0.05, (bin(v).count("1") - 1) / (LABELERS - 1))) for v in counts}
        hit, false = [0.8] * LABELERS, [0.2] * LABELERS
        for _ in range(rounds):
            yes, no = sum(q[v] * n for v, n in counts.items()), sum((1 - q[v]) * n for v, n in counts.items())
            prior = (yes + 1) / (yes + no + 2)
            for j in range(LABELERS):
                hit[j] = (sum(q[v] * n for v, n in counts.items() if v >> j & 1) + 4) / (yes + 5)
                false[j] = (sum((1 - q[v]) * n for v, n in counts.items() if v >> j & 1) + 1) / (no + 5)
            for v in counts:
                z = math.log(prior / (1 - prior))
                for j in range(LABELERS):
                    z += math.log(hit[j] / false[j]) if v >> j & 1 else math.log((1 - hit[j]) / (1 - false[j]))
                q[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        out |= {(kind, v): p for v, p in q.items()}
        rates |= {(kind, j): (hit[j], false[j]) for j in range(LABELERS)}
    return out, rates


def span_classifier(patterns: list[Pattern], q: dict[tuple[str, int], float], steps: int = 300, rate: float = 0.5) -> dict[str, list[float]]:
    """Logistic weights (bias first) by kind, fitted to the patterns' posteriors by gradient descent."""
    out = {}
    for kind in KINDS:
        rows = [(votes, feats, n) for k, votes, feats, n in patterns if k == kind]
        total, w = sum(n for *_, n in rows) or 1, [0.0] * (FEATURES + 1)
        if not rows:
            w[0] = -30.0
        for _ in range(steps if rows else 0):
            g = [1e-3 * x for x in w]
            for votes, feats, n in rows:
                z = w[0] + sum(w[j + 1] for j in range(FEATURES) if feats >> j & 1)
                d = (1 / (1 + math.exp(-z)) - q[kind, votes]) * n / total
                g[0] += d
                for j in range(FEATURES):
                    g[j + 1] += d * (feats >> j & 1)
            w = [x - rate * 4 * y for x, y in zip(w, g, strict=True)]
        out[kind] = w
    return out


def accepted(found: Column, weights: dict[str, list[float]]) -> Column:
    """The strict spans, and those that the classifier adds."""

    def score(x: Column) -> Column:
        z = F.lit(0.0)
        for kind, w in weights.items():
            one = F.lit(w[0])
            for j in range(FEATURES):
                one = one + F.when(F.getbit(x["features"], F.lit(j)) == 1, w[j + 1]).otherwise(0.0)
            z = F.when(x["kind"] == kind, one).otherwise(z)
        return 1 / (1 + F.exp(-z))

    base = F.filter(found, lambda x: x["strict"])
    more = F.filter(found, lambda x: ~x["strict"] & (score(x) >= THRESHOLD))
    far = 1 << 30

    def free(order: Column) -> Column:
        """Those of `more`: in order of start, no strict span before one ends beyond its start, none after it starts before its end."""
        reach = running_max(F.transform(order, lambda t: F.when(t["x"]["strict"], t["end"]).otherwise(-1)))
        begin = F.reverse(running_max(F.reverse(F.transform(order, lambda t: F.when(t["x"]["strict"], -t["start"]).otherwise(-far)))))
        placed = F.zip_with(F.zip_with(order, reach, lambda t, r: F.struct(t["x"].alias("x"), r.alias("reach"))), begin, lambda z, b: F.struct(z["x"].alias("x"), z["reach"].alias("reach"), b.alias("begin")))
        return F.transform(F.filter(placed, lambda z: ~z["x"]["strict"] & (z["reach"] <= z["x"]["start"]) & (-z["begin"] >= z["x"]["end"])), lambda z: z["x"])

    order = F.array_sort(F.transform(F.concat(base, more), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("x"))))
    return F.when(F.exists(found, lambda x: ~x["strict"] & (score(x) >= THRESHOLD)), F.concat(base, _let(order, free))).otherwise(base)


def learn(found: DataFrame) -> dict[str, list[float]]:
    """Fit on the candidates of all documents (column `found`)."""
    flat = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.features").count()
    patterns = sorted((r["kind"], r["votes"], r["features"], r["count"]) for r in flat.collect())  # bounded: see above
    return span_classifier(patterns, posteriors(patterns)[0])


def _listed(spans: Column) -> Column:
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.lit(list(KINDS)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found array, accepted array) of every document."""
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"})
    found = C.staged(texts.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("found")), "pii")
    return found.withColumn("accepted", accepted(F.col("found"), learn(found)))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by its kind in brackets; n_chars follows where there is one."""
    text = docs["text"].cast("string")
    told = C.staged(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), candidates(F.coalesce(text, F.lit(""))).alias("found")), "told")
    weights = learn(told)
    order = F.array_sort(F.transform(accepted(F.col("found"), weights), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    t = F.col("row.text").cast("string")
    state = "struct<at:int,out:array<string>>"
    begin = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def one(run: Column, base: Column) -> Column:
        """The text from `base` to the end of a run of spans, masked; spans within one before go with it."""
        piece = F.substring(t, base + 1, F.greatest(F.lit(0), F.array_max(F.transform(run, lambda x: x["end"])) - base))

        def step(acc: Column, x: Column) -> Column:
            out = F.when(x["start"] >= acc["at"], F.array_append(acc["out"], F.concat(F.substring(piece, acc["at"] - base + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]")))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out")).cast(state)

        return F.aggregate(run, begin(base), step)

    def done(acc: Column, run: Column) -> Column:
        return F.transform(F.array(one(run, acc["at"])), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], F.array_join(r["out"], "")).alias("out")).cast(state))[0]

    masked = F.aggregate(_parts(order), begin(F.lit(0)), done, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    new = F.when(F.size(order) > 0, masked).otherwise(t)
    out = told.select("row", new.alias("new"))
    kind = dict(docs.dtypes)
    put = {"text": F.col("new").cast(kind["text"]), "n_chars": F.when(F.col("row.text").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(kind.get("n_chars", "long")) if "n_chars" in kind else None}
    return out.select(*[(put[c] if c in put else F.col("row")[c]).alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(C.documents(spark, sf_dir))
    base = F.filter("found", lambda x: x["strict"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["strict"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("accepted")).alias("spans"))


QUERIES: dict[str, Callable] = {"op9_pii": op9_pii}
