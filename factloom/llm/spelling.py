"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

The vocabulary is sorted and dealt by ranges of words into parts of some ``PART_WORDS``; each part's words
become a minimal acyclic automaton whose edges carry perfect-hash offsets, so that the sum along a path
is the word's number in its part.  A second set of parts does the same with all words spelt backwards.
Of two words one edit apart, the first or the second half of one stands unchanged in the other.  So a word
visits the forward parts that may hold its first half, walks it exactly and completes the rest with one
error, and does the same with its second half in the backward parts; the backward side leaves out what
the forward side finds.  A half that very many words begin with lies in several parts, all of which the
word visits, so no part grows with it.  Each visit returns a count and the best word, not pairs.

Words follow their forms to the root by pointer jumping: a form has at least twice its word's count, so
chains have at most log2 of the greatest count links, and the rounds the logarithm of that.

Cases: null texts have no words; a row without an id is not damaged; texts and words of any length count
whole; repeated rows count again; ties go to the word least in code-point order; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import by_bytes, discard, only, saved

#: Words of an automaton, about.
PART_WORDS = 50_000
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as its word.
RATIO = 2
#: One run in so many loses a code point in the query.
DAMAGED = 97
_NOT_IN_RUN = r"[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts after all that begins with the text before it.
_LAST = "\U0010ffff"


class Automaton:
    """Minimal acyclic automaton of sorted different words; ``edges[state][c]`` is (next state, offset)."""

    def __init__(self, words: list[str]):
        self.edges, self.final, self.counts = [], [], []
        register: dict[tuple, int] = {}
        # The path of the last word, not yet frozen: (its edges so far, whether a word ends here).
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                edges, final = path.pop()
                path[-1][0][last[len(path) - 1]] = self._state(register, edges, final[0])

        for word in words:
            shared = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                shared += 1
            freeze(shared)
            path.extend(({}, [False]) for _ in range(len(word) - shared))
            path[-1][1][0] = True
            last = word
        freeze(0)
        self.start = self._state(register, path[0][0], path[0][1][0])

    def _state(self, register: dict[tuple, int], edges: dict[str, int], final: bool) -> int:
        key = (final, tuple(edges.items()))
        if key not in register:
            register[key] = len(self.edges)
            number, numbered = int(final), {}
            for c, state in edges.items():  # in order, since the words are sorted
                numbered[c] = (state, number)
                number += self.counts[state]
            self.edges.append(numbered)
            self.final.append(final)
            self.counts.append(number)
        return register[key]

    def walk(self, text: str, state: int, number: int = 0) -> tuple[int, int] | None:
        """(state, number) after ``text``, or None."""
        for c in text:
            found = self.edges[state].get(c)
            if found is None:
                return None
            state, number = found[0], number + found[1]
        return state, number

    def near(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that begin with ``exact`` and go on as ``rest`` with one edit."""
        at, found = self.walk(exact, self.start), set()

        def complete(tail: str, state: int, number: int) -> None:
            end = self.walk(tail, state, number)
            if end is not None and self.final[end[0]]:
                found.add(end[1])

        for i in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            c, tail = rest[i : i + 1], rest[i + 1 :]
            if c:
                complete(tail, state, number)  # c is missing
            for other, (after, offset) in self.edges[state].items():
                complete(rest[i:], after, number + offset)  # other is inserted
                if c and other != c:
                    complete(tail, after, number + offset)  # other stands for c
            at = self.walk(c, state, number) if c else None
        return found


def runs(text: Column) -> Column:
    """Maximal runs of letters from A to Z and from U+00C0 to U+00FF, as they stand."""
    return F.array_remove(F.split(text, _NOT_IN_RUN), "")


def _lowered(run: Column) -> Column:
    """``run`` with only A to Z lower-cased."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def damaged(run: Column, key: Column) -> Column:
    """``run`` without code point h % length where ``DAMAGED`` divides h, the crc32 of ``key:run``."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least five code points with at least three occurrences; ``id_col`` damages runs."""
    key = F.lit("") if id_col is None else F.col(id_col).cast("string")
    # What is shorter than a word before a loss is so afterwards.
    long_runs = F.filter(runs(F.col(text_col)), lambda r: F.char_length(r) >= LEAST_LENGTH)
    df = docs.select(key.alias("key"), F.explode(long_runs).alias("run")).select("key", _lowered(F.col("run")).alias("run"))
    word = F.col("run") if id_col is None else damaged(F.col("run"), F.col("key"))
    df = df.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return df.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _dealt(words: DataFrame, parts: int) -> DataFrame:
    """(part, key, word, n): ``words`` with their spelling forward or backward as key, in parts that are ranges of keys."""
    df = words.repartitionByRange(parts, "key").select(F.spark_partition_id().alias("part"), "key", "word", "n")
    return saved(df, "parts")


def _halves(word: str, forward: bool) -> tuple[str, str]:
    """(the half that stands unchanged, the rest), both in the direction of the automaton."""
    half = len(word) // 2
    return (word[:half], word[half:]) if forward else (word[half:][::-1], word[:half][::-1])


def _one_way(words: DataFrame, parts: int, forward: bool) -> DataFrame:
    """(word, n_near, best): of each word and part that it visits, how many near words there are and the best."""
    key = F.col("word") if forward else F.reverse("word")
    dealt = _dealt(words.select(key.alias("key"), "word", "n"), parts)
    ranges = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("first").collect()  # a row a part
    firsts, lasts, numbers = ([r[c] for r in ranges] for c in ("first", "last", "part"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            found, word = [], batch.column(0).to_pylist()
            for i, w in enumerate(word):
                exact = _halves(w, forward)[0]
                # The parts that hold something between the half and all that begins with it.
                found.extend((numbers[k], i) for k in range(bisect_left(lasts, exact), bisect_right(firsts, exact + _LAST)))
            taken = batch.take(pa.array([i for _, i in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), *taken.columns], names=["part", "word", "n"])

    asking = words.select("word", "n").mapInArrow(visits, "part int, word string, n long")
    both = dealt.select("part", F.lit(0).alias("asks"), "key", "word", "n").unionByName(asking.select("part", F.lit(1).alias("asks"), F.col("word").alias("key"), "word", "n"))
    both = both.repartition("part").sortWithinPartitions("part", "asks", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling")
        now, keys, counts, automaton = None, [], [], None
        for batch in by_bytes(batches, 2):
            out: list[tuple[str, int, int, str]] = []
            for part, asks, key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, keys, counts, automaton = part, [], [], None
                if not asks:
                    keys.append(key)
                    counts.append(n)
                    continue
                automaton = automaton or Automaton(keys)
                exact, rest = _halves(word, forward)
                near = [(-counts[k], keys[k] if forward else keys[k][::-1]) for k in automaton.near(exact, rest)]
                if not forward:
                    first = word[: len(word) // 2]
                    near = [x for x in near if not x[1].startswith(first)]
                if near:
                    best = min(near)
                    out.append((word, len(near), -best[0], best[1]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    return both.mapInArrow(search, "word string, n_near long, best_n long, best string")


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of all words in ``forms`` (word, form), by pointer jumping."""
    now = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("its"), F.col("root").alias("next"))
        further = now.join(on, F.col("root") == F.col("its"), "left")
        further = saved(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = further
    return now.drop("moved")


def variants(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of different words."""
    words = saved(words.select("word", "n"), "words")
    parts = max(1, -(-words.count() // part_words))
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"), "n")
    found = [_one_way(words, parts, forward).withColumn("n", F.lit(None).cast("long")) for forward in (True, False)]
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    df = none.unionByName(found[0]).unionByName(found[1]).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    is_form = -F.col("best.n") >= RATIO * F.col("n")
    df = saved(df.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = _rooted(df.where("form IS NOT NULL")).withColumnRenamed("word", "its")
    return df.join(roots, F.col("word") == F.col("its"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(crc) -> str:
    """DuckDB SQL for the query; ``crc`` makes the SQL of a text's crc32."""
    from factloom.llm.structure import CRC_TABLE

    return rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), told AS (
  SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc("(cast(doc_id AS VARCHAR) || ':' || run)")} AS h FROM told, crc
), vocabulary AS (
  SELECT word, cast(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), shorter AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), pair AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM shorter a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM shorter a JOIN vocabulary v ON a.rest = v.word
), ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pair
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * v.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON v.word = r.word AND k = 1
), chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
