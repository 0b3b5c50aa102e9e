"""Personal data: fixed spans against a plain search, disguised spans on rows that trained nothing, and hard cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import personal

#: The fixed patterns as the contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def card(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def made(rng):
    """One span of each kind."""
    return {
        "email": f"{rng.choice(('ann.b', 'x_y', 'joe77', 'm+k'))}{rng.randint(0, 99)}@{rng.choice(('mail', 'web3', 'a-b'))}.{rng.choice(('example.com', 'org', 'co.uk'))}",
        "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card(rng),
        "phone": f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    }


WORDS = "lorem ipsum dolor ünïcode 𝒳yz sit amet. at dot 12 7.5 2021-03-04 10:20 v1.2.3 nr 9807915762804490 100,000 items".split()


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        for value in made(rng).values():
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words)), value)
        out.append(" ".join(words))
    return out


HARD = [
    None,
    "",
    "a@b.com@c.dd.%x@y.z_q@r.s--t@u",
    "x@y.1..2@z.w",
    "1.2.3.4.5.6.7.8.9 001.002.003.004 256.1.1.1 1.2.3 0000000255.1.1.1 4294967297.1.1.1",
    "+1......2......3......4......5......6......7......8 +1+22+333+4444444444 +(1) 5",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111114111111111111111",
    "é𝒳日本 " * 5 + "ann@example.com 𝒳 10.0.0.1",
    "9" * 30_000 + " " + "a" * 30_000 + "@" + "b.c" * 10_000,
    ("ann1@mail.org +1 (377) 555-0271 " * 700),
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t) for i, t in enumerate(texts(600, 1))]
    return personal.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_fixed_spans(spark, model):
    given = HARD + texts(80, 2)
    rows = [(i, t, "x", 3, "y") for i, t in enumerate(given)] + [(0, "ann@example.com", "x", 3, "y")] * 2 + [(None, "10.0.0.1", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, added int, spans string").select("doc_id", "text")
    for trees in (model, personal.Trees([], [])):
        got = personal.report(personal.with_spans(docs, trees)).collect()
        assert len(got) == len(rows)
        want = sorted((-1 if i is None else i, ",".join(base(t or ""))) for i, t, *_ in rows)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256) for r in got) == sorted((i, digest(s)) for i, s in want)
        for r in got:
            mine = next(s for i, s in want if i == (-1 if r.doc_id is None else r.doc_id) and digest(s) == r.base_sha256)
            spans = r.spans.split(",") if r.spans else []
            assert set(filter(None, mine.split(","))) <= set(spans)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [mine.count(k + ":") for k in personal.KINDS]
            if not trees.trees:
                assert r.spans == mine
            order = [(personal.KINDS.index(k), int(b), int(e)) for k, b, e in (s.split(":") for s in spans)]
            assert order == sorted(order)


def test_disguised_spans_are_added_and_prose_is_left_alone(spark, model):
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(60):
        one = made(rng)
        number = one["card"]
        shown = (
            one["email"].replace("@", " [at] ").replace(".", " [dot] "),
            one["email"].replace("@", "(at)").replace(".", "(dot)"),
            one["ip"].replace(".", "[.]"),
            ".".join(number[i : i + 4] for i in range(0, 16, 4)),
            f"{card(rng)} {card(rng)}"[:33],
            f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        )
        for text in shown:
            rows.append((n, f"Ipsum dolor {text} sit amet.", True))
            n += 1
    clean = ["Meet at noon. Then go at once.", "version 1.2.3 of 2021-03-04 10:20", "order 9807915762804490", "nr 1234 5678 and 100,000,000 items", "spread at the. Dot on it", "it was at that dot"] * 20
    rows += [(n + i, t, False) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, holds boolean")
    found = personal.with_spans(docs, model)
    rate = {r.holds: r.rate for r in found.groupBy("holds").agg(F.avg((F.size("added") > 0).cast("int")).alias("rate")).collect()}
    assert rate[True] >= 0.9 and rate[False] <= 0.02, rate
    # Nothing added touches a fixed span.
    clash = F.exists("added", lambda a: F.exists("base", lambda b: (a["begin"] < b["end"]) & (a["end"] > b["begin"])))
    mixed = personal.with_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts(100, 5))], "doc_id long, text string"), model)
    assert mixed.where(clash).count() == 0


def test_redaction(spark, model):
    docs = spark.createDataFrame([("é𝒳 ann@example.com, 10.0.0.1!",), ("none",)], "text string")
    found = personal.with_spans(docs, model).select(personal.redacted(F.col("text"), F.concat("base", "added")).alias("out"))
    assert [r.out for r in found.collect()] == ["é𝒳 " + "*" * 15 + ", " + "*" * 8 + "!", "none"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "no personal data, only 12.5 and 1234 5678 90")], "doc_id long, text string")
    model = personal.fit(docs)
    assert model.trees == [] and personal.report(personal.with_spans(docs, model)).first().spans == ""
    empty = docs.limit(0)
    assert personal.report(personal.with_spans(empty, personal.fit(empty))).count() == 0


def test_no_python_worker_on_the_main_path(spark, model):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("doc_id", "text")
    plan = personal.report(personal.with_spans(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
