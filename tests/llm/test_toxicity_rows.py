"""A document's toxicity score stands alone; unseen misspellings are found; recall holds for every seed."""

import os

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import toxicity
from factloom.llm.labelled import fold

SF = "/root/testdata/sf0.1"

TEXTS = ["one two", "two", "two", "", "two three", None, "three", "three three four", "four", "", "Ünï köln—vier «fünf»", " \n"]


@pytest.mark.parametrize("sign", [1, -1])
def test_neighbours_do_not_change_a_score(sign):
    table = (sign * 1e4 * np.abs(np.random.default_rng(8).normal(size=1 << toxicity.BITS))).astype(np.int32)
    model = toxicity.Model(table, np.array([1.0, 2.0, 0.5, -1.0]))
    alone = [model.scores([t])[0] for t in TEXTS]
    assert model.scores(TEXTS).tolist() == alone
    assert model.scores(TEXTS[::-1]).tolist() == alone[::-1]
    for text in ("idiot", "idiot idiot", "a", "the end"):
        assert model.scores([text] * 3).tolist() == model.scores([text]).tolist() * 3
    assert model.scores(["weather weather nice"])[0] == pytest.approx(model.scores(["weather nice weather"])[0])
    assert model.scores(["", None, " . "]).tolist() == [0, 0, 0]


def plain_averages(text, table):
    """The three averages by their definition."""
    words, numbers = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()], []
    for word in words:
        data = b" " + word.encode() + b" "
        grams = [data[i : i + n] for n in toxicity.SIZES for i in range(len(data) - n + 1)]
        numbers.append([int(table[int.from_bytes(g, "little") * int(toxicity._MULTIPLIER) % 2**64 >> 64 - toxicity.BITS]) for g in grams])
    of_word = {w: sum(n) / len(n) for w, n in zip(words, numbers, strict=True)}
    top = sorted(of_word.values(), reverse=True)[: toxicity.BAG]
    return np.array([top[0], np.mean(top), sum(map(sum, numbers)) / sum(map(len, numbers))]) / toxicity._STEPS


def test_averages_against_their_definition():
    table = (1e4 * np.random.default_rng(9).normal(size=1 << toxicity.BITS)).astype(np.int32)
    texts = [t for t in TEXTS if t and t.strip()] + ["a b c d e f g", "Same same SAME other"]
    got = toxicity.averages(pa.array(texts, pa.large_string()), table)
    assert got == pytest.approx(np.array([plain_averages(t, table) for t in texts]))


def _corpus(rng, n, bad):
    word = lambda: "".join(rng.choice(list("etaoinshr"), int(rng.integers(3, 8))))
    docs = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(20, 80)))]
        if i % 4 == 0:
            words += list(rng.choice(bad, 3, replace=False))
        docs.append((" ".join(words), i % 4 == 0))
    return docs


def test_unseen_misspellings_are_found():
    rng = np.random.default_rng(2)
    bad = ["wretchmug", "grubkins", "slimeball", "dunderpate", "muckface", "foulwick"]
    docs = _corpus(rng, 800, bad)
    words = toxicity.different_words(pa.array([t for t, _ in docs], pa.large_string()))
    model = toxicity.train([w for w, (_, b) in zip(words, docs, strict=True) if b], [w for w, (_, b) in zip(words, docs, strict=True) if not b])
    fresh = _corpus(rng, 400, ["wretchmugg", "wrechmug", "grubkinz", "grubkns", "slimebal", "slim3ball", "dunderpaet", "muckfaec", "foulwiick", "f0ulwick"])
    scores = model.scores([t for t, _ in fresh])
    found = scores >= toxicity.THRESHOLD
    toxic = np.array([b for _, b in fresh])
    assert found[toxic].mean() > 0.9 and found[~toxic].mean() < 0.05


def test_every_different_word_trains():
    many = " ".join(f"w{i}" for i in range(10_000)) + " " + "x" * 100
    assert [len(w.split()) for w in toxicity.different_words(pa.array([many, "a A b", ""], pa.large_string()))] == [10_001, 2, 0]


def test_one_procedure_at_every_size():
    """A single document a side, or sides of different size, take the same way."""
    for toxic, clean in (([b"foul wick"], [b"fair day"]), ([b"foul wick"] * 3, [b"fair day"] * 30), ([b"foul"], [b"fair"] * 9)):
        scores = toxicity.train(toxic, clean).scores(["foul wick", "fair day", "", None])
        assert ((scores >= 0) & (scores <= 1)).all() and scores[2] == scores[3] == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_recall_holds_for_every_seed(spark):
    """Fold 0 of the driver's documents: at least 0.9 found and at most 3 clean ones called toxic, whatever the seed (SEEDS of them, 10 in README)."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(fold() == 0).join(docs, "doc_id").select("toxic", "text").toArrow()
    toxic = held["toxic"].to_numpy() == 1
    figures = []
    for seed in range(int(os.environ.get("SEEDS", 2))):
        found = toxicity.fit(docs, labels, seed=seed).scored(held["text"].combine_chunks()) >= toxicity.THRESHOLD
        figures.append((float(found[toxic].mean()), int(found[~toxic].sum())))
    print(figures)
    assert all(recall >= 0.9 and wrong <= 3 for recall, wrong in figures), figures


def test_training_texts_are_one_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None)], "doc_id long, text string")
    from factloom.llm.labelled import texts_of

    ids = spark.createDataFrame([(1, True), (2, False)], "doc_id long, bad boolean")
    assert texts_of(docs, ids).count() == 2
