"""Personal data: generated spans, boosted trees and calibrated thresholds, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import spare, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values). Possessive repeats and the look-behinds leave every match as it is;
#: they spare the matcher recursion and second walks over the same run of characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall patterns: what looks like one of the kinds at all, written out or broken.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){2,}+|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,}+)",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){11,}+(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![A-Za-z])",
}
#: What must occur in a text before the pattern is tried on it.
GATE = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9][\x20()./-]{0,2}[0-9]"}
#: The same for the base patterns: any run of separators may stand between the digits of a phone number.
BASE_GATE = {**GATE, "phone": r"\+[0-9]"}
#: Words that announce a kind (fixed values).
CUES = {"email": "mail|contact|write|schreib|correo|courriel", "ip": "ip|host|server|addr", "card": "card|visa|pay|karte|tarjeta|carte|iban|konto", "phone": "tel|phone|call|fax|mobil|ruf"}
FEATURES, CONTEXT, HELD, PRECISION = 7, 24, 4, 0.95


def located(df: DataFrame, text: str, pattern: str, gate: str, into: str) -> DataFrame:
    """``into``: all leftmost non-overlapping matches as (s, e, v, l, r): code point span, match, what is left and right of it.

    A text splits at its matches, so positions are running sums of the lengths of the pieces, in
    blocks of 64 pieces so that texts with many matches stay cheap.
    """
    found, gaps, steps, sums = spare(df, "_found", "_gaps", "_steps", "_sums")
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(F.col(text).rlike(gate), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(steps, F.transform(F.col(found), lambda v, i: (F.length(v) + F.length(F.get(F.col(gaps), i))).cast("long")))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(sums, F.transform(blocks, lambda b: add(F.slice(F.col(steps), b * 64 + 1, F.lit(64)))))

    def span(v: Column, i: Column) -> Column:
        block = F.shiftright(i, 6)
        end = add(F.slice(F.col(sums), F.lit(1), block)) + add(F.slice(F.col(steps), block * 64 + 1, i - block * 64 + 1))
        left, right = F.get(F.col(gaps), i), F.get(F.col(gaps), i + 1)
        return F.struct((end - F.length(v)).alias("s"), end.alias("e"), v.alias("v"), F.right(left, F.lit(CONTEXT)).alias("l"), F.left(right, F.lit(CONTEXT)).alias("r"))

    return df.withColumn(into, F.transform(F.col(found), span)).drop(found, gaps, steps, sums)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """The rule that a base match of ``kind`` must pass."""
    n = F.length(digits(v))
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return n.between(13, 19) & luhn(digits(v))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def label(kind: str, c: Column) -> Column:
    """Distant label of a wide candidate: 1 if the base rules accept it, 0 if it is plainly something else, null if open.

    No feature tells this outright. Open are what the base rules cannot see: written-out addresses,
    the long form of network addresses, and grouped numbers without a plus sign.
    """
    v = c["v"]
    if kind == "email":
        whole = v.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
        return F.when(whole, 1).when(v.rlike(r"[\[(\x20]"), F.lit(None)).otherwise(0)
    if kind == "ip":
        return F.when(v.contains(":"), F.lit(None)).when(valid(kind, v), 1).otherwise(0)
    if kind == "card":
        return F.when(valid(kind, v), 1).otherwise(0)
    plus = F.rtrim(c["l"]).rlike(r"\+(?:[0-9]{1,3})?$") & F.length(digits(v)).between(7, 15)
    other = v.rlike(r"^[0-9]++$|^(?:19|20)[0-9]{2}[./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}") | ~F.length(digits(v)).between(7, 15)
    return F.when(plus, 1).when(other, 0)


def features(kind: str, c: Column) -> list[Column]:
    """Format and context of a candidate as small whole numbers."""
    v, left, right = c["v"], c["l"], c["r"]
    separators = F.length(F.regexp_replace(v, r"[A-Za-z0-9]", ""))
    side = lambda x, p: F.when(x.rlike(p), 1).when(x == "", 2).otherwise(0)
    return [
        F.least(F.length(digits(v)), F.lit(20)),
        F.least(separators, F.lit(7)),
        F.when(v.rlike(r"[()\[\]]"), 3).when(v.rlike(r"\x20"), 2).when(v.rlike(r"[.:-]"), 1).otherwise(0),
        F.when(v.rlike(r"^\(?[0-9]{3}[).\x20-]{1,2}[0-9]{3}[.\x20-][0-9]{4}$"), 1).when(v.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 2).when(v.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 3).when(v.rlike(r"\.[A-Za-z]{2,6}$"), 4).when(v.rlike(r"^(?:19|20)[0-9]{2}[./-]"), 5).otherwise(0),
        side(left, r"(?:^|[\s:=<(\[\"'])$"),
        side(right, r"^(?:[.,;:!?)\]>\"']{0,2}(?:\s|$))"),
        F.when(F.lower(left).rlike(rf"\b(?:{CUES[kind]})"), 1).otherwise(0),
    ]


def findings(docs: DataFrame) -> DataFrame:
    """One pass over all texts: doc_id, ``base`` and ``wide`` spans of every row, written once.

    ``base`` holds (kind number, s, e) of the base rules, ``wide`` (kind number, s, e, features,
    label). A row of this table is a row of ``docs``; nothing is grouped or shuffled.
    """
    df = docs.select("doc_id", text_of().alias("text"))
    for kind in KINDS:
        df = located(df, "text", BASE[kind], BASE_GATE[kind], f"b_{kind}")
        df = located(df, "text", WIDE[kind], GATE[kind], f"w_{kind}")

    def base(n: int, kind: str) -> Column:
        kept = F.filter(F.col(f"b_{kind}"), lambda c: valid(kind, c["v"]))
        return F.transform(kept, lambda c: F.struct(F.lit(n).alias("k"), c["s"].alias("s"), c["e"].alias("e")))

    def wide(n: int, kind: str) -> Column:
        return F.transform(F.col(f"w_{kind}"), lambda c: F.struct(F.lit(n).alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.array(*features(kind, c)).alias("x"), label(kind, c).cast("int").alias("y")))

    both = df.select("doc_id", F.xxhash64("text").alias("fold"), F.concat(*[base(n, k) for n, k in enumerate(KINDS)]).alias("base"), F.concat(*[wide(n, k) for n, k in enumerate(KINDS)]).alias("wide"))
    return written(both.withColumn("fold", (F.pmod("fold", F.lit(HELD)) == 0).cast("int")))


def train(found: DataFrame, precision: float = PRECISION) -> dict[str, Boosted]:
    """A boosted model per kind from the counted feature patterns of all labelled candidates of the corpus."""
    rows = found.select("fold", F.explode("wide").alias("c")).filter("c.y is not null").groupBy("fold", "c.k", "c.x", "c.y").count().collect()
    models = {}
    for n, kind in enumerate(KINDS):
        own = sorted((r["fold"], tuple(r["x"]), r["y"], r["count"]) for r in rows if r["k"] == n)
        part = [[(x, y, m) for fold, x, y, m in own if fold == f] for f in (0, 1)]
        if part[0]:
            models[kind] = fit(part[0], part[1], precision)
    return models


def selected(models: dict[str, Boosted]) -> Column:
    """Candidates at or above their kind's threshold that touch no base span: (k, s, e)."""

    def keep(c: Column) -> Column:
        chosen = F.lit(False)
        for n, kind in enumerate(KINDS):
            if kind in models and math.isfinite(models[kind].threshold):
                x = [F.get(c["x"], F.lit(i)) for i in range(FEATURES)]
                chosen = chosen | ((c["k"] == n) & (models[kind].column(x) >= models[kind].threshold))
        return chosen & ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    return F.transform(F.filter(F.col("wide"), keep), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"], c["e"])), ",")


def pii_table(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans.

    Spans are in code points, end exclusive, by kind and start. Base spans are always kept. Wide
    candidates, which may overlap each other, come on top if their kind's boosted trees score them at
    the threshold from which ``precision`` of the held-out candidates are right. Null texts are
    empty; repeated rows are found each for itself; only ``doc_id`` and ``text`` are read.
    """
    found = findings(docs)
    out = found.withColumn("base", F.array_sort("base")).withColumn("added", selected(train(found, precision)))
    count = lambda n: F.size(F.filter(F.col("base"), lambda c: c["k"] == n)).cast("long")
    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span (k, s, e) replaced by its kind in brackets; of overlapping spans the first in the text counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        piece = F.substr(text, (a["at"] + 1).cast("int"), (c["s"] - a["at"]).cast("int"))
        return F.when(c["s"] < a["at"], a).otherwise(F.struct(c["e"].alias("at"), F.concat(a["out"], piece, F.get(names, c["k"])).alias("out")))

    return F.aggregate(by_start, state, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))
