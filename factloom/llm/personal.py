"""Personal data: generous candidate spans, boosted trees over format and context, calibrated thresholds.

Spans of four kinds (email, ip, card, phone) follow fixed patterns and always count.  Beside them one
generator a kind proposes what looks like the kind in another spelling: ``name [at] host [dot] org``,
addresses with bracketed dots, card numbers with other separators, phone numbers without a plus.
Gradient-boosted trees score each proposal by its format and by the words around it; a proposal that
reaches its kind's threshold and touches no fixed span is added.  Proposals of different kinds may
overlap, as fixed spans may.

The trees are fitted on all documents, without labels by hand: the fixed spans are respelt in the disguises
above and stand, in their own contexts, for personal data; proposals that touch no fixed span, and respelt
spans made invalid, stand for the rest.  Examples that the trees see alike are one row with their number as
weight, so the fit's rows are as many as there are different sights and not as many as spans; no example is
left out.  A third of the examples is kept back, and each kind's threshold lets at most ``FALSE_RATE`` of
those among them pass that are no personal data.

Scoring is one pass over the texts without a shuffle.  Places come from the lengths between matches,
summed in blocks of ``BLOCK`` matches.  The trees become a column expression.

Cases: null texts are empty; texts of any length are taken whole; repeated rows stay rows of their own;
without fixed spans nothing is added; an empty table gives no rows; extra columns stay in
``with_spans`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import saved

KINDS = ("email", "ip", "card", "phone")
#: Share of the kept-back rows that are no personal data which may pass a threshold.
FALSE_RATE = 0.002
BLOCK = 256
TREES, DEPTH = 12, 3
#: Characters on both sides of a candidate that are its context.
CONTEXT = 32

#: The patterns of the base spans.  Possessive loops and looks behind change no match; they
#: keep the work linear in the text and the stack flat.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT = r"(?:[ ]{0,2}(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]|\{dot\})[ ]{0,2}|[ ]{1,2}dot[ ]{1,2})"
_AT = r"[ ]{0,2}(?:@|\(at\)|\[at\]|\{at\}|\(@\)|\[@\])[ ]{0,2}"
_HOST = "[a-z0-9-]{1,63}"
GENERATORS = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}(?:{_AT}{_HOST}(?:{_DOT}{_HOST}){{1,6}}|[ ]{{1,2}}at[ ]{{1,2}}{_HOST}(?:[ ]{{1,2}}dot[ ]{{1,2}}{_HOST}){{1,6}})",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[ ]?(?:\.|\[\.\]|\(\.\)|,)[ ]?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/ ‐-―-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./()-]{1,3}[0-9]{2,5}){1,5}(?![0-9])",
}
#: What every text with a match holds: four digits with neither letters nor other digits between them, or one of these words.
_NUMBERS = r"[0-9](?:[^0-9A-Za-z]*+[0-9]){3}"
_SPOKEN = ("(at", "[at", "{at", "(@", "[@", " dot ", "(AT", "[AT", "{AT", " DOT ")
_NEAR = {
    "email": r"(?i)mail|contact|write|reach|courriel|correo",
    "ip": r"(?i)\bip\b|host|server|addr|ping|login|dns",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|cell|whatsapp",
}
#: Disguises by kind: (pattern, replacement) pairs, one after the other.
DISGUISES = {
    "email": (((r"@", " [at] "), (r"\.", " [dot] ")), ((r"@", "(at)"), (r"\.", "(dot)")), ((r"@", " at "), (r"\.", " dot ")), ((r"@", " @ "),), ((r"@", "[at]"),), ((r"@", " (at) "), (r"\.(?=[^.]*$)", " . "))),
    "ip": (((r"\.", "[.]"),), ((r"\.", "(.)"),), ((r"\.(?=[0-9]+$)", "[.]"),), ((r"\.", " . "),), ((r"\.", ","),)),
    "card": (((r"[ -]", ""),), *(((r"[ -]", ""), (r"([0-9]{4})(?=[0-9])", "$1" + by)) for by in (".", "/", "  ", "_", "–", " - "))),
    "phone": (((r"^\+[0-9]{1,2}[ .-]*", ""),), ((r"^\+", "00"),), ((r"^\+[0-9]{1,2}[ .-]*", ""), (r"[()]", ""), (r"[ -]+", ".")), ((r"^\+[0-9]{1,2}[ .-]*", ""), (r"[()]", ""), (r"[ .]+", "-"))),
}
#: What looks alike and is no personal data: digits that fail the checks, dates and times.
SPOILT = {
    "email": (((r"@", " at "), (r"\.", ". ")), ((r"@[^.]*", " at the"), (r"\.", ". "))),
    "ip": (((r"\.", "[.]"), (r"[0-9]+$", "999")), ((r"\.", ", "), (r"^[0-9]+", "512"))),
    "card": (((r"[ -]", ""), (r"([0-9]{4})(?=[0-9])", "$1."), (r"[0-4]$", "7")), ((r"[ -]", ""), (r"[5-9]$", "0"), (r"([0-9]{4})(?=[0-9])", "$1/"))),
    "phone": (((r"^.*([0-9]{2})$", "2019-11-$1"),), ((r"^.*([0-9])([0-9])$", "10.0$1.199$2"),), ((r"^.*([0-9]{2})$", "2024-01-2$1 10.$1"),), ((r"^.*([0-9]{2})$", "$104 31$1"),), ((r"^.*([0-9])([0-9])$", "$18$20.4$111.$2062"),)),
}
SPAN = "struct<kind: int, begin: bigint, end: bigint>"
_FOUND = "struct<kind: int, begin: bigint, end: bigint, value: string, before: string, after: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = lambda i: digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weighed = F.transform(places, lambda i: F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return (F.length(digits) > 0) & (F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0)


def _octets(value: Column) -> Column:
    """Whether all numbers in ``value`` are at most 255."""
    numbers = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+", ""))
    return F.forall(numbers, lambda n: (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255")))


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _plausible(kind: str, value: Column) -> Column:
    """Whether a proposal has as many digits as its kind can have."""
    bounds = {"card": (13, 19), "phone": (7, 15)}.get(kind)
    return F.length(_digits(value)).between(*bounds) if bounds else F.lit(True)


def _located(df: DataFrame, kind: str, pattern: str, name: str, worth: Column) -> DataFrame:
    """Adds ``name``: all matches of ``pattern`` with their places in code points and their contexts, where ``worth`` holds."""
    gaps, hits, sizes, sums = f"{name}_gaps", f"{name}_hits", f"{name}_sizes", f"{name}_sums"
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, F.when(worth, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("_text", pattern, -1)))
    n = F.size(hits)
    df = df.withColumn(sizes, F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long")))
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    df = df.withColumn(f"{sums}_of", F.when(n > 0, blocks))
    df = df.withColumn(sums, F.transform(f"{sums}_of", lambda _, i: total(F.slice(f"{sums}_of", F.lit(1), i))))
    gap = lambda i: F.element_at(gaps, i + 1)

    def place(hit: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        begin = F.element_at(sums, block + 1) + total(F.slice(sizes, block * BLOCK + 1, i % BLOCK)) + F.char_length(gap(i))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            begin.alias("begin"),
            (begin + F.char_length(hit)).alias("end"),
            hit.alias("value"),
            F.right(gap(i), F.lit(CONTEXT)).alias("before"),
            F.left(gap(i + 1), F.lit(CONTEXT)).alias("after"),
        )

    # The sums are named outside the lambda too: the optimizer would else work them out again for each match.
    placed = F.coalesce(F.when(F.size(sums) > 0, F.transform(hits, place)), F.array().cast(f"array<{_FOUND}>"))
    return df.withColumn(name, placed).drop(gaps, hits, sizes, sums, f"{sums}_of")


def _touches(blocks: Column, span: Column) -> Column:
    """Whether a span meets one of the sorted spans in ``blocks`` (first, last, spans)."""
    inside = lambda b: F.exists(b["spans"], lambda s: (s["begin"] < span["end"]) & (s["end"] > span["begin"]))
    return F.exists(blocks, lambda b: (b["first"] < span["end"]) & (b["last"] > span["begin"]) & inside(b))


def _spans(df: DataFrame, text_col: str, proposals: bool) -> DataFrame:
    """Adds _base (fixed spans by kind and begin) and, if asked for, _proposed (proposals that touch none of them)."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    # A text without a match fails a cheap test.
    df = df.withColumns({"_numbers": F.col("_text").rlike(_NUMBERS), "_at": F.contains("_text", F.lit("@"))})
    for kind, pattern in BASE.items():
        df = _located(df, kind, pattern, f"_{kind}", F.col("_at") if kind == "email" else F.col("_numbers"))
    valid = lambda kind: F.filter(f"_{kind}", lambda s: _valid(kind, s["value"]))
    df = df.withColumn("_base", F.concat(*map(valid, KINDS))).drop(*(f"_{kind}" for kind in KINDS))
    if not proposals:
        return df.drop("_text", "_numbers", "_at")
    spoken = reduce(lambda a, b: a | b, (F.contains("_text", F.lit(w)) for w in _SPOKEN), F.col("_at"))
    for kind, pattern in GENERATORS.items():
        df = _located(df, kind, pattern, f"_{kind}", spoken if kind == "email" else F.col("_numbers"))
    by_begin = F.array_sort(F.transform("_base", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    df = df.withColumn("_sorted", by_begin)
    cut = lambda b: F.slice("_sorted", b * BLOCK + 1, F.lit(BLOCK))
    block = lambda b: F.struct(cut(b)[0]["begin"].alias("first"), F.array_max(F.transform(cut(b), lambda s: s["end"])).alias("last"), cut(b).alias("spans"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_sorted") - 1) / BLOCK).cast("int")), block)
    df = df.withColumn("_blocks", F.when(F.size("_sorted") > 0, blocks).otherwise(F.array().cast("array<struct<first: bigint, last: bigint, spans: array<struct<begin: bigint, end: bigint>>>>")))
    plausible = lambda kind: F.filter(f"_{kind}", lambda s: _plausible(kind, s["value"]))
    proposed = F.concat(*map(plausible, KINDS))
    free = F.when(F.size("_blocks") == 0, proposed).otherwise(F.filter(proposed, lambda s: ~_touches(F.col("_blocks"), s)))
    return df.withColumn("_proposed", free).drop("_text", "_numbers", "_at", "_sorted", "_blocks", *(f"_{kind}" for kind in KINDS))


def _seen(span: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in features(span).items()))


def _n(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def features(span: Column) -> dict[str, Column]:
    """What the trees see of a span (kind, value, before, after)."""
    value, before, after = span["value"], span["before"], span["after"]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    digits = _digits(value)
    named = reduce(lambda rest, k: F.when(span["kind"] == KINDS.index(k), before.rlike(_NEAR[k]) | after.rlike(_NEAR[k])).otherwise(rest), KINDS, F.lit(False))
    number = lambda c: F.when(span["kind"] == KINDS.index("email"), F.lit(0.0)).otherwise(c)
    return {
        "kind": span["kind"].cast("double"),
        "digits": number(F.length(digits).cast("double")),
        "groups": number(F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))).cast("double")),
        "blanks": number(_n(value, "[^ ]")),
        "dots": number(_n(value, r"[^.]")),
        "brackets": _n(value, r"[^\[\](){}]"),
        "strokes": number(_n(value, r"[^-/_,:‐-―]")),
        "luhn": number(flag(_luhn(digits))),
        "octets": number(flag(_octets(value))),
        "plus": number(flag(F.startswith(value, F.lit("+")))),
        "year": number(flag(value.rlike(r"^(19|20)[0-9]{2}\b|\b(19|20)[0-9]{2}$"))),
        "dialled": number(flag(value.rlike(r"^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-]{1,2}[0-9]{4}$|^00[0-9]"))),
        "bracketed_at": flag(value.rlike(r"(?i)[(\[{]\s?(at|@)\s?[)\]}]")),
        "at_sign": flag(F.contains(value, F.lit("@"))),
        "spoken_dot": flag(value.rlike(r"(?i)(?<![a-z])dot(?![a-z])")),
        "dot_then_blank": flag(value.rlike(r"[A-Za-z0-9]\.\s")),
        "attached": flag(before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")),
        "goes_on": flag(before.rlike(r"[-./:,]\s?$")),
        "named": flag(named),
    }


def _respelt(spans: DataFrame, ways: dict, name: str) -> DataFrame:
    """(kind, value, before, after): every span respelt by each of its kind's ``ways``."""
    def spelt(kind: str) -> Column:
        made = [reduce(lambda v, step: F.regexp_replace(v, step[0], step[1]), way, F.col("value")) for way in ways[kind]]
        return F.array(*made)

    by_kind = reduce(lambda rest, k: F.when(F.col("kind") == KINDS.index(k), spelt(k)).otherwise(rest), KINDS, F.array().cast("array<string>"))
    out = spans.select("kind", F.col("value").alias("plain"), F.explode(by_kind).alias("value"), "before", "after")
    if name == "spoilt":  # what passes the card's check by chance is no counter-example
        out = out.where((F.col("value") != F.col("plain")) & ((F.col("kind") != KINDS.index("card")) | ~_luhn(_digits(F.col("value")))))
    return out.drop("plain")


class Trees:
    """Boosted trees as nested (feature, bound, left, right) or leaves, with a threshold a kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, seen: Column, names: list[str]) -> Column:
        def node(t: object) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            feature, bound, left, right = t
            return F.when(seen[names[feature]] <= bound, node(left)).otherwise(node(right))

        return reduce(lambda a, b: a + b, [F.lit(w) * node(t) for w, t in self.trees], F.lit(0.0))


def _tree(node) -> object:
    """A fitted tree's node as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def fit(docs: DataFrame, text_col: str = "text") -> Trees:
    """Trees and thresholds from all of ``docs``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    found = saved(_spans(docs.select(F.col(text_col).alias("text")), "text", proposals=True).select("_base", "_proposed"), "fit-spans")
    base = found.select(F.explode("_base").alias("s")).select("s.*").drop("begin", "end").distinct()
    # What passes the card's check as it stands may be a card: it is no counter-example.
    plain = found.select(F.explode("_proposed").alias("s")).select("s.*").drop("begin", "end").distinct()
    plain = plain.where((F.col("kind") != KINDS.index("card")) | ~_luhn(_digits(F.col("value"))))
    sorts = [(1.0, _respelt(base, DISGUISES, "disguised")), (0.0, _respelt(base, SPOILT, "spoilt")), (0.0, plain)]
    examples = reduce(DataFrame.unionByName, [df.select("kind", "value", "before", "after").withColumn("label", F.lit(label)) for label, df in sorts])
    span = F.struct("kind", "value", "before", "after")
    examples = examples.select("label", (F.xxhash64("kind", "value") % 3 == 0).alias("kept_back"), _seen(span).alias("f")).select("label", "kept_back", "f.*")
    names = examples.columns[2:]
    examples = saved(examples.groupBy("label", "kept_back", *names).agg(F.count("*").cast("double").alias("n")), "fit-examples")
    tallied = examples.where("NOT kept_back").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("sights")).collect()
    counts = {r.label: r.n for r in tallied}
    if not counts.get(1.0) or not counts.get(0.0):
        return Trees([], [2.0] * len(KINDS))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(examples)
    # From so many bins on, MLlib looks for splits in all rows and not in some of them.
    bins = max(32, math.isqrt(sum(r.sights for r in tallied)) + 1)
    model = GBTClassifier(maxBins=bins, maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="n").fit(vectors.where("NOT kept_back").select("label", "features", "n"))
    trees = Trees([(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)], [])
    seen = F.struct(*names)
    # Rows at or above each score, by kind: precision there decides; a row a kind and sum of leaves.
    scored = examples.where("kept_back").select(F.col("kind").cast("int").alias("kind"), "label", "n", trees.margin(seen, names).alias("m"))
    tally = scored.groupBy("kind", "m").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).orderBy("kind", F.desc("m")).collect()
    for k in range(len(KINDS)):
        rows = [r for r in tally if r.kind == k]
        rest = sum(r.n - r.good for r in rows)
        wrong, bound = 0.0, float("inf")
        for i, r in enumerate(rows):
            wrong += r.n - r.good
            if wrong > FALSE_RATE * rest:
                break
            if r.good:  # half way to the next lower score, but never below even odds
                bound = max((r.m + rows[i + 1].m) / 2 if i + 1 < len(rows) else r.m, 0.0)
        trees.thresholds.append(bound)
    return trees


def with_spans(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with base (the fixed spans) and added (the proposals that the trees select): arrays of (kind, begin, end), by kind and begin."""
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))
    used = bool(model.trees)
    df = _spans(docs, text_col, proposals=used)
    df = df.withColumn("base", F.array_sort(F.transform("_base", bare)))
    if not used:
        return df.withColumn("added", F.array().cast(f"array<{SPAN}>")).drop("_base")
    names = list(features(F.struct(F.lit(0).alias("kind"), *(F.lit("").alias(c) for c in ("value", "before", "after")))))
    df = df.withColumn("_seen", F.transform("_proposed", lambda s: F.struct(bare(s).alias("span"), _seen(s).alias("f"))))
    bound = lambda kind: reduce(lambda rest, k: F.when(kind == k, F.lit(model.thresholds[k])).otherwise(rest), range(len(KINDS)), F.lit(float("inf")))
    chosen = F.filter("_seen", lambda s: model.margin(s["f"], names) >= bound(s["span"]["kind"]))
    df = df.withColumn("added", F.array_sort(F.transform(chosen, lambda s: s["span"])))
    return df.drop("_base", "_proposed", "_seen")


def listed(spans: Column) -> Column:
    """``kind:begin:end`` of spans, joined by commas."""
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span's characters as asterisks, for spans that were found in it."""
    by_begin = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["begin"])
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        stars = F.repeat(F.lit("*"), F.greatest(s["end"] - begin, F.lit(0)).cast("int"))
        return F.struct(F.concat(acc["out"], gap, stars).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(by_begin, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``with_spans`` returns."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select(id_col, *(n(k) for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))
