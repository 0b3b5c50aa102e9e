"""Spelling variants against all pairs by plain edit distance, and words against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import spelling

_LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= 2 * n else None
        forms[w] = form[1] if form else None
        out[w] = [n, len(near), form[1] if form else None, -form[0] if form else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def made(n, seed, letters="abé", lengths=(5, 8)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice((3, 4, 7, 9, 30, 200)) for _ in range(n)}


def test_automaton_is_minimal_and_numbers_words_in_order():
    words = sorted(made(400, 1))
    automaton = spelling.Automaton(words)
    for k, word in enumerate(words):
        state, number = automaton.walk(word, automaton.start)
        assert automaton.final[state] and number == k
    assert automaton.walk("zzz", automaton.start) is None
    # Minimal: no two states have the same words after them.
    after = [None] * len(automaton.edges)
    for state, edges in enumerate(automaton.edges):
        after[state] = frozenset({""} if automaton.final[state] else set()) | {c + rest for c, (child, _) in edges.items() for rest in after[child]}
    assert len(set(after)) == len(after)
    for word in words[:50]:
        exact, rest = word[: len(word) // 2], word[len(word) // 2 :]
        assert automaton.near(exact, rest) == {k for k, v in enumerate(words) if v.startswith(exact) and one_edit(word, v)}


@pytest.mark.parametrize("part_words", [11, 10_000])
def test_variants(spark, part_words):
    counts = made(150, 2) | made(40, 3, "aab", (5, 6)) | {"x" * 3000: 5, "x" * 2999: 50, "x" * 2998: 500, "lonely": 3}
    words = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, form string")
    assert got(spelling.variants(words, part_words)) == expected(counts)


def test_vocabulary(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("Straße", "ÉCOLE", "école", "banana,", "Bananas", "bänana", "tiny", "ba-nana", "naïveté×x")) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (20, None), (21, ""), (None, "nulled nulled nulled"), (22, "longlong" * 4000 + " tail")] + [(23, "longlong" * 4000)] * 3
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    plain, hurt = Counter(), Counter()
    for i, text in rows:
        for run in _LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            plain[run] += 1
            h = zlib.crc32(f"{i}:{run}".encode())
            hurt[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 and i is not None else run] += 1
    keep = lambda c: {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}
    assert keep(plain) != keep(hurt)
    assert {r.word: r.n for r in spelling.vocabulary(docs, None).collect()} == keep(plain)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == keep(hurt)
    assert got(spelling.variants(spelling.vocabulary(docs))) == expected(keep(hurt))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).count() == 0
