"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (3 to 6 bytes, blanks as word ends),
which are hashed into one table, so a misspelling nobody has seen shares most vectors with the word.
A bag is the average of several words' vectors and goes through a linear softmax.  Vectors and softmax
are trained together on bags of a document's ``BAG`` different words that look most toxic, chosen anew
each round: those of toxic documents carry the label toxic, those of clean ones, and bags of random
words of theirs, the label clean; toxic bags are drawn as often as half the clean ones, and some words
are misspelt at random.

After averaging the model is linear, so table and softmax fold into one number an n-gram.  ``FOLDS``
such tables are learnt, each from all training documents but one fold, and the model's table is their
mean, which steadies it against the chance of a single run.  Three averages make a document's score:
that of its most toxic word, that of its ``BAG`` most toxic different words, and that of all its
n-grams.  A logistic curve weighs them; it is fitted on all training documents, each scored by the
table that has not seen it.  The numbers are integers, so a text's score is the same alone, in any order
and in any batch.

Bounds: ``TOXIC`` and ``CLEAN`` labelled documents train it, each by all of its different words, which
executors pick; scoring reads every whole text.

Cases: null, empty and blank texts score 0; a text of any length counts whole; repeated rows and extra
columns stay; of labelled rows with one id, the text of the least hash trains; if the labels hold no
toxic or no clean document every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import codepoints
from factloom.llm.labelled import fold, sampled, texts_of
from factloom.llm.shared import by_bytes, gathered, only, text_bytes

TOXIC, CLEAN = 2_000, 4_000
THRESHOLD = 0.5
#: Different words of a bag.
BAG = 3
#: Tables, each of which leaves out one fold of the training documents.
FOLDS = 4
#: How far the curve levels the classes: 0 leaves them as they are, 1 lets both weigh the same.
LEVELLED = 0.65
BITS, WIDTH = 18, 8
SIZES = (3, 4, 5, 6)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: All but letters, marks and digits parts words.
_CLASSES = (r"\p{L}", r"\p{M}", r"\p{N}")
#: Share of a batch's bags, and of their words, that are misspelt in training; forms of a word a round.
MISSPELT, FORMS = (0.5, 0.5), 2
#: Steps of an n-gram number.
_STEPS = 1 << 16


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts with a blank around each and in place of all that parts words, where each text begins)."""
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())
    data, at = text_bytes(lowered)
    kind = codepoints.classes(data, codepoints.table(_CLASSES))
    begins = at[:-1] + np.arange(1, len(at))
    out = np.full(len(data) + len(at), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(at)), np.diff(at))] = np.where(kind < len(_CLASSES), data, 32)
    return out, begins


def _ngrams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (bucket of the n-gram at each place, whether it lies in one word)."""
    blank, wide = data == 32, data.astype(np.uint64)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = wide[:n].copy()
        inside = np.zeros(n, bool)
        for j in range(1, size):
            code |= wide[j : n + j] << np.uint64(8 * j)
            if j < size - 1:
                inside |= blank[j : n + j]
        code *= _MULTIPLIER
        yield (code >> np.uint64(64 - BITS)).astype(np.int32), ~inside


def _words(data: np.ndarray) -> np.ndarray:
    """Where each word begins."""
    blank = data == 32
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1


def _totals(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of each word's n-gram numbers, how many they are)."""
    total, count = np.zeros(len(data), np.int64), np.zeros(len(data), np.int32)
    for bucket, valid in _ngrams(data):
        total[1 : len(bucket) + 1] += table[bucket] * valid
        count[1 : len(bucket) + 1] += valid
    return np.add.reduceat(total, starts), np.add.reduceat(count, starts)


def averages(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The three averages of each text; nan if it has no words."""
    out = np.full((len(texts), 3), np.nan)
    data, begins = _spaced(texts)
    starts = _words(data)
    if not len(starts):
        return out
    first = np.searchsorted(starts, np.append(begins, len(data)))
    total, count = _totals(data, starts, table)
    score = total / count
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if a < b:
            top, rest = [], score[a:b]
            while len(rest) and len(top) < BAG:  # equal words have equal numbers
                top.append(float(rest.max()))
                rest = rest[rest < top[-1]]
            out[i] = top[0], sum(top) / len(top), total[a:b].sum() / count[a:b].sum()
    return out / _STEPS


class Model:
    """n-gram numbers and the curve that makes a score of a text's averages."""

    def __init__(self, table: np.ndarray, weights: np.ndarray):
        self.table, self.weights = table, weights

    def scored(self, texts: pa.Array) -> np.ndarray:
        if not len(self.table):
            return np.zeros(len(texts))
        means = averages(texts, self.table)
        known = ~np.isnan(means[:, 0])
        margin = (np.where(known[:, None], means, 0) * self.weights[:-1]).sum(axis=1) + self.weights[-1]
        return np.where(known, 1 / (1 + np.exp(-np.clip(margin, -60, 60))), 0.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.scored(pa.array(texts, pa.large_string()))


class _Grams:
    """n-grams of words, by size: those of word i are buckets[begins[i] : begins[i] + counts[i]]."""

    def __init__(self, joined: bytes):
        """``joined`` holds the words with one blank between them."""
        data = np.frombuffer(b" " + joined + b" ", np.uint8)
        starts = _words(data)
        self.parts = []
        for bucket, valid in _ngrams(data):
            # An n-gram belongs to the word that its second place lies in.
            ends = np.searchsorted(at := np.flatnonzero(valid), np.append(starts[1:], len(data)) - 1).astype(np.int32)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int32)
            self.parts.append((bucket[at], begins, ends - begins))
        self.counts = np.sum([counts for _, _, counts in self.parts], axis=0)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all n-grams of the words, size by size, the place in ``words`` that each belongs to)."""
        found = [(gathered(buckets, begins[words], counts[words])[0], np.repeat(np.arange(len(words)), counts[words])) for buckets, begins, counts in self.parts]
        return np.concatenate([b for b, _ in found]), np.concatenate([o for _, o in found])

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The sum of each word's n-gram numbers."""
        total = np.zeros(len(self.counts))
        for buckets, begins, counts in self.parts:
            some = counts > 0
            if some.any():
                total[some] += np.add.reduceat(table[buckets], begins[some])
        return total


def _misspelt(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with a letter dropped, doubled, swapped or replaced; short words stay."""
    if len(word) < 4:
        return word
    made, at, kind = bytearray(word), int(rng.integers(1, len(word) - 1)), int(rng.integers(0, 4))
    if kind == 0:
        del made[at]
    elif kind == 1:
        made.insert(at, made[at])
    elif kind == 2:
        made[at], made[at + 1] = made[at + 1], made[at]
    else:
        made[at] = b"abcdefghijklmnopqrstuvwxyz0134"[int(rng.integers(0, 30))]
    return bytes(made)


class _Net:
    """Vectors and softmax, with what Adagrad remembers of their gradients."""

    def __init__(self, rng: np.random.Generator):
        self.vectors, self.softmax = rng.normal(0, 0.1, (1 << BITS, WIDTH)), rng.normal(0, 0.5, (WIDTH + 1, 2))
        self.softmax[-1] = 0
        self.of_vectors, self.of_softmax = np.full(1 << BITS, 1e-4), np.full((WIDTH + 1, 2), 1e-2)

    def table(self) -> np.ndarray:
        return self.vectors @ (self.softmax[:-1, 1] - self.softmax[:-1, 0])

    def step(self, grams: _Grams, bags: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One gradient step on bags of words (-1 where a bag has fewer)."""
        bag_of_word = np.repeat(np.arange(len(bags)), bags.shape[1])[bags.ravel() >= 0]
        words = bags.ravel()[bags.ravel() >= 0]
        in_bag = np.bincount(bag_of_word, minlength=len(bags))
        bucket, word = grams.of(words)
        bag = bag_of_word[word]
        share = (1 / (grams.counts[words] * in_bag[bag_of_word]))[word]
        picked = self.vectors[bucket] * share[:, None]
        mean = np.stack([np.bincount(bag, picked[:, j], len(bags)) for j in range(WIDTH)], axis=1)
        logits = mean @ self.softmax[:-1] + self.softmax[-1]
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(labels)), labels] -= 1  # the gradient of the logits
        back = chance @ self.softmax[:-1].T
        gradient = np.vstack([mean.T @ chance, chance.sum(axis=0)]) / len(bags)
        self.of_softmax += gradient**2
        self.softmax -= rate * gradient / np.sqrt(self.of_softmax)
        touched, place = np.unique(bucket, return_inverse=True)
        change = np.stack([np.bincount(place, back[bag, j] * share, len(touched)) for j in range(WIDTH)], axis=1)
        self.of_vectors[touched] += (change**2).mean(axis=1)
        self.vectors[touched] -= rate * change / np.sqrt(self.of_vectors[touched])[:, None]


def _bag(words: np.ndarray) -> np.ndarray:
    return np.pad(words, (0, BAG - len(words)), constant_values=-1)


def _top(docs: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
    return np.array([_bag(d[np.argsort(-scores[d], kind="stable")[:BAG]]) for d in docs]).reshape(-1, BAG)


def _random(docs: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    return np.array([_bag(rng.choice(d, min(BAG, len(d)), replace=False)) for d in docs]).reshape(-1, BAG)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and shift of the logistic curve over averages, by Newton's method with a small penalty; no average counts against a text.

    A class weighs as its number of rows to the power 1 - ``LEVELLED``: the rarer one counts for more than its share.
    """
    weight = np.where(y > 0, max(1, (y > 0).sum()) ** -LEVELLED, max(1, (y <= 0).sum()) ** -LEVELLED)
    weight *= len(y) / weight.sum()
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    used = np.ones(x.shape[1], bool)
    while True:
        design = np.hstack([(x - middle)[:, used] / scale[used], np.ones((len(x), 1))])
        w, penalty = np.zeros(design.shape[1]), np.append(np.full(used.sum(), 0.5), 0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty) + np.eye(len(w)) * 1e-6
            w -= np.linalg.solve(hessian, design.T @ (weight * (p - y)) + penalty * w)
        if (w[:-1] >= 0).all() or used.sum() == 1:
            break
        used[np.flatnonzero(used)[w[:-1] < 0]] = False
        if not used.any():
            used[0] = True
    weights = np.zeros(x.shape[1])
    weights[used] = w[:-1] / scale[used]
    return np.append(weights, w[-1] - (weights * middle).sum())


def _learnt(words: pa.Array, grams: _Grams, bad: list[np.ndarray], good: list[np.ndarray], rng: np.random.Generator, rounds: int, passes: int, batch: int, rate: float) -> np.ndarray:
    """One n-gram table from documents as arrays of word numbers; zeros if a side is empty."""
    if not bad or not good:
        return np.zeros(1 << BITS)
    net = _Net(rng)
    # Log odds of each n-gram, by how many documents hold its words, choose the first bags.
    share = np.zeros((2, 1 << BITS))
    for side, some in enumerate((bad, good)):
        holding = np.bincount(np.concatenate(some), minlength=len(words)) / len(some)
        for buckets, _, counts in grams.parts:
            share[side] += np.bincount(buckets, np.repeat(holding, counts), 1 << BITS)
    table = np.maximum(0, np.log((share[0] + 0.002) / (share[1] + 0.002)))
    for round_ in range(rounds):
        scores = grams.sums(table) / grams.counts
        toxic_bags, clean_bags = _top(bad, scores), np.vstack([_top(good, scores), _random(good, rng)])
        used = np.unique(np.concatenate([toxic_bags.ravel(), clean_bags.ravel()]))
        used = used[used >= 0]
        plain = words.take(pa.array(used)).to_pylist()
        local = _Grams(b" ".join([*plain, *(_misspelt(w, rng) for _ in range(FORMS) for w in plain)]))
        toxic_bags, clean_bags = (np.where(b >= 0, np.searchsorted(used, b), -1) for b in (toxic_bags, clean_bags))
        for _ in range(passes):
            drawn = toxic_bags[rng.integers(0, len(toxic_bags), max(len(toxic_bags), len(clean_bags) // 2))]
            bags, labels = np.vstack([drawn, clean_bags]), np.repeat([1, 0], [len(drawn), len(clean_bags)])
            blurred = (rng.random((len(bags), 1)) < MISSPELT[0]) & (rng.random(bags.shape) < MISSPELT[1]) & (bags >= 0)
            bags = np.where(blurred, bags + len(used) * rng.integers(1, FORMS + 1, bags.shape), bags)
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                net.step(local, bags[some], labels[some], rate * (1 - round_ / (rounds + 1)))
        table = net.table()
    return table


def train(toxic: list[bytes], clean: list[bytes], rounds: int = 6, passes: int = 2, batch: int = 256, rate: float = 0.2, seed: int = 5) -> Model:
    """Train on documents given by their different words, with blanks between them."""
    rng = np.random.default_rng(seed)
    parts = [[d for d in docs if d] for docs in (toxic, clean)]
    if not all(parts):
        return Model(np.zeros(0, np.int32), np.zeros(4))
    parts = [[docs[i] for i in rng.permutation(len(docs))] for docs in parts]
    held = pc.split_pattern(pa.array([d for docs in parts for d in docs], pa.large_binary()), b" ")
    words = held.flatten().dictionary_encode()
    docs = np.split(words.indices.to_numpy(), held.offsets.to_numpy()[1:-1])
    words, first_clean = words.dictionary, len(parts[0])
    toxic_ids, clean_ids = docs[:first_clean], docs[first_clean:]
    grams = _Grams(b" ".join(words.to_pylist()))
    tables, means, labels = [], [], []
    for fold_ in range(FOLDS):
        others = [[d for i, d in enumerate(side) if i % FOLDS != fold_] for side in (toxic_ids, clean_ids)]
        table = np.round(_learnt(words, grams, *others, rng, rounds, passes, batch, rate) * _STEPS).astype(np.int32)
        tables.append(table)
        for label, side in ((1.0, parts[0]), (0.0, parts[1])):
            texts = [d.decode("utf-8", "replace") for d in side[fold_::FOLDS]]
            if texts:
                means.append(np.concatenate([averages(part, table) for part in by_bytes([pa.array(texts, pa.large_string())])]))
                labels.append(np.full(len(texts), label))
    return Model(np.round(np.mean(tables, axis=0)).astype(np.int32), _curve(np.concatenate(means), np.concatenate(labels)))


def different_words(texts: pa.Array) -> list[bytes]:
    """The different words of each text that train a model, with blanks between them."""
    data, begins = _spaced(texts)
    held = data.tobytes()
    ends = [*begins[1:].tolist(), len(data)]
    return [b" ".join(sorted({w for w in held[a:b].split(b" ") if w})) for a, b in zip(begins.tolist(), ends, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, seed: int = 5) -> Model:
    """Train on at most ``toxic`` + ``clean`` labelled documents, none of them held out."""
    known = labels.where(fold() != 0)
    ids = sampled(known.where("toxic = 1"), toxic).withColumn("bad", F.lit(True)).unionByName(sampled(known.where("toxic = 0"), clean).withColumn("bad", F.lit(False)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(different_words(batch.column(1)), pa.binary())], names=["bad", "words"])

    found = texts_of(docs, ids).select("bad", "text").mapInArrow(rows, "bad boolean, words binary").toArrow()  # at most toxic + clean rows
    return train(*(sorted(found["words"].filter(pc.equal(found["bad"], bad)).to_pylist()) for bad in (True, False)), seed=seed)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("toxicity")
        for texts in batches:
            yield pa.concat_arrays([pa.array(shared.value.scored(part)) for part in by_bytes([texts])] or [pa.array([], pa.float64())])

    return docs.withColumn(name, score(F.col(text_col)))
