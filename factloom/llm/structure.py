"""Repair of conversations' structure: each distinct signature of roles and faults is solved once.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length spreads over as
many tasks as it needs, and are cut there into chunks of at most ``CHUNK_TURNS`` turns and
``CHUNK_BYTES`` bytes.  A chunk carries a code a turn: the role's class and its first fault.  A
conversation's codes make its signature; the distinct signatures are solved by memoised recursion, the
audits are joined back, and every chunk replays its piece.  A conversation that lies in one chunk away
from its task's edges needs nothing else; for the others only codes, and digests of texts across tasks,
are shuffled.  Signatures shared by more than one conversation in ``HOT_SIGNATURES`` (at most that many)
are broadcast, the rest are joined by shuffle.

Faults, the first of which counts: blank (no character beside white space), duplicate (role and text
seen earlier in the conversation), truncated (the last character but white space is none of ``.!?``).
Edits: K keeps a turn (0), R gives it the role user or assistant (2), D deletes it (3, and required for
blank and duplicate turns), I inserts an empty turn (2); a truncated turn that stays adds 1.  The audit
holds the cheapest edits in order, ties by least ASCII; the roles must read ``(s?(ua)+)?`` by initials.
Of an audit, the roles of reroled and inserted turns follow: there is one that fits at each place.

Cases: null roles and texts are one space; an empty or unknown role fits nowhere and must be reroled or
deleted; null turn numbers come first; turns of one number follow in order of role and text; a null
conversation id is an id like others; repeated rows are duplicates; conversations all of whose rows are
marked dropped, and they only, have an empty result; texts of any length stay whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm.shared import by_bytes, saved

CHUNK_TURNS, CHUNK_BYTES = 1_024, 2 << 20
#: A signature of more than one conversation in so many is broadcast, so at most so many are.
HOT_SIGNATURES = 10_000
#: First characters of a text by which ranges of equal turn numbers are told apart.
PREFIX = 32
_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: By state (begin, after s, after u, after a): the state after a user's or assistant's turn that fits there.
_NEXT = (2, 2, 3, 2)
_ROLES = {2: "user", 3: "assistant"}
_ENDS = (0, 3)
#: Suffixes that are solved at once, which bounds the depth of the recursion.
_BLOCK = 100
_NEVER = 1 << 60


def _kept(code: str, state: int) -> int | None:
    """The state after a turn that keeps its role, or None if it does not fit."""
    role = code.lower()
    if role == "s":
        return 1 if state == 0 else None
    if role == "u":
        return 2 if state != 2 else None
    return 3 if role == "a" and state == 2 else None


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature: u, a, s, o (another role), upper case if truncated, x if to be deleted."""
    n, memo = len(signature), {}

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(initial, cost, next place, next state), by initial; insertions left aside."""
        if i < n:
            code = signature[i]
            yield "D", 3, i + 1, state
            if code != "x":
                if (after := _kept(code, state)) is not None:
                    yield "K", int(code.isupper()), i + 1, after
                yield "R", 2 + int(code.isupper()), i + 1, _NEXT[state]

    def cost(i: int, state: int) -> int:
        if (i, state) not in memo:
            least = _NEVER
            now = state
            for inserted in range(3):  # a third insertion would come back to a state passed before
                if i == n and now in _ENDS:
                    least = min(least, 2 * inserted)
                for _, price, j, after in edits(i, now):
                    least = min(least, 2 * inserted + price + cost(j, after))
                now = _NEXT[now]
            memo[i, state] = least
        return memo[i, state]

    for i in range(n, -1, -_BLOCK):
        for state in range(4):
            cost(i, state)
    audit, i, state = [], 0, 0
    while i < n or state not in _ENDS:
        options = sorted([*edits(i, state), ("I", 2, i, _NEXT[state])])
        name, _, i, state = next(o for o in options if o[1] + cost(o[2], o[3]) == cost(i, state))
        audit.append(name)
    return cost(0, 0), "".join(audit)


def replay(turns: list[dict], audit: str, state: int = 0) -> tuple[list[dict], int]:
    """(the turns after the edits of ``audit``, the state they end in)."""
    out, rest = [], iter(turns)
    for edit in audit:
        if edit == "D":
            next(rest)
            continue
        turn = {"role": "", "text": ""} if edit == "I" else next(rest)
        if edit == "K":
            state = _kept(turn["role"][:1], state)
        else:
            state = _NEXT[state]
            turn = {"role": _ROLES[state], "text": turn["text"]}
        out.append(turn)
    return out, state


def _fault(text: str) -> str:
    """b for a blank text, t for a truncated one, else nothing."""
    stripped = text.rstrip(_BLANKS)
    return "b" if not stripped else "" if stripped[-1] in ".!?" else "t"


class _Chunk:
    """The turns of one conversation gathered so far in a task."""

    def __init__(self, conv, part: int, chunk: int, seen: set[bytes]):
        self.conv, self.part, self.chunk, self.seen = conv, part, chunk, seen
        self.turns, self.codes, self.initials, self.digests, self.numbers, self.bytes = [], [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        fault = _fault(text)
        digest = None if fault == "b" else hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if digest is not None and digest in self.seen:
            fault = "d"
        elif digest is not None:
            self.seen.add(digest)
        initial = role[:1] if role[:1] in ("u", "a", "s") else "o"
        self.turns.append({"role": role, "text": text})
        self.codes.append(fault if fault in ("b", "d") else initial.upper() if fault else initial)
        self.initials.append(role[:1] or "-")
        self.digests.append(digest)
        self.bytes += len(text) + len(role)
        if turn is not None and (not self.numbers or self.numbers[-1] != turn):
            self.numbers.append(turn)

    def row(self, whole: bool) -> dict:
        joined = "".join(self.initials)
        return {
            "conv": self.conv,
            "part": self.part,
            "chunk": self.chunk,
            "whole": whole,
            "turns": self.turns,
            "codes": "".join(self.codes),
            "ends": joined[:1] + joined[-1:],
            "illegal": sum(joined[i : i + 2] not in _LEGAL for i in range(len(joined) - 1)),
            "first_turn": self.numbers[0] if self.numbers else None,
            "last_turn": self.numbers[-1] if self.numbers else None,
            "n_turns": len(self.numbers),
            "digests": None if whole else self.digests,
        }


_CHUNK = "part int, chunk int, whole boolean, turns array<struct<role: string, text: string>>, codes string, ends string, illegal long, first_turn long, last_turn long, n_turns long, digests array<binary>"


def _batches(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of some 2 MB."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str | StructType, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def chunks(turns: DataFrame, id_col: str = "conv_id", dropped: Column | None = None, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Conversations' turns in order, coded, as rows of (id, part, chunk); ``dropped`` marks rows that are gone."""
    gone = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    text = lambda name: F.when(~F.col("gone"), F.coalesce(F.col(name).cast("string"), F.lit(" "))).otherwise("")
    df = turns.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", gone.alias("gone"))
    df = df.select("conv", "turn", text("role").alias("role"), text("text").alias("text"), "gone")
    df = df.withColumn("start", F.substring("text", 1, PREFIX)).repartitionByRange("conv", "turn", "role", "start")
    df = df.sortWithinPartitions("conv", "turn", "role", "text").drop("start")
    ddl = f"conv {df.schema['conv'].dataType.simpleString()}, {_CHUNK}"
    schema = _arrow(ddl, turns.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            now, first = None, True
            for batch in by_bytes(batches, 3):
                for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or now.conv != conv:
                        if now is not None:
                            yield now.row(whole=now.chunk == 0 and not first)
                            first = False
                        now = _Chunk(conv, part, 0, set())
                    elif len(now.turns) >= chunk_turns or now.bytes >= CHUNK_BYTES:
                        yield now.row(whole=False)
                        now = _Chunk(conv, part, now.chunk + 1, now.seen)
                    if not gone:
                        now.add(turn, role, text)
            if now is not None:
                yield now.row(whole=False)

        yield from _batches(rows(), schema, lambda r: 200 + 2 * len(r["codes"]) + sum(len(t["text"]) for t in r["turns"]))

    return saved(df.mapInArrow(cut, ddl), "turns")


def _across(parted: DataFrame) -> DataFrame:
    """Chunks of conversations that lie in several, with the turns marked that an earlier task has seen."""
    place = F.struct("part", "chunk", "i")
    pos = parted.select("conv", "part", "chunk", F.posexplode("digests").alias("i", "digest")).where("digest IS NOT NULL")
    seen = pos.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = pos.join(seen.withColumnRenamed("conv", "its"), F.col("conv").eqNullSafe(F.col("its")) & (pos["digest"] == seen["digest"])).where(place > F.col("first"))
    later = later.groupBy(F.col("conv").alias("its"), F.col("part").alias("its_part"), F.col("chunk").alias("its_chunk")).agg(F.collect_set("i").alias("again"))
    same = F.col("conv").eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")) & (F.col("chunk") == F.col("its_chunk"))
    marked = F.array_join(F.transform(F.split("codes", ""), lambda c, i: F.when(F.array_contains("again", i), "d").otherwise(c)), "")
    return parted.drop("digests").join(later, same, "left").withColumn("codes", F.when(F.col("again").isNotNull(), marked).otherwise(F.col("codes"))).select(*[c for c in parted.columns if c != "digests"])


def _counts(codes: Column) -> list[Column]:
    n = lambda c: (F.length(codes) - F.length(F.replace(codes, F.lit(c), F.lit("")))).cast("long")
    truncated = F.length(F.regexp_replace(codes, "[^UASO]", "")).cast("long")
    return [n("b").alias("blank"), n("d").alias("duplicate"), truncated.alias("truncated")]


def _signature(codes: Column) -> Column:
    return F.translate(codes, "bd", "xx")


def _summaries(parted: DataFrame) -> DataFrame:
    """One row a conversation of several chunks: its signature, its counts, and its chunks' codes in order."""
    piece = F.struct("part", "chunk", "codes", "ends", "illegal", "first_turn", "last_turn", "n_turns")
    df = parted.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    filled = F.filter("pieces", lambda p: F.length(p["codes"]) > 0)
    numbered = F.filter("pieces", lambda p: p["n_turns"] > 0)
    df = df.withColumns({"filled": filled, "numbered": numbered})
    total = lambda name, field: F.aggregate(name, F.lit(0).cast("long"), lambda n, p: n + p[field])
    beside = lambda name, f: F.zip_with(F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0))), F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))), f)
    count = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    meets = count(beside("filled", lambda x, y: ~F.concat(F.substring(x["ends"], -1, 1), F.substring(y["ends"], 1, 1)).isin(*sorted(_LEGAL))))
    again = count(beside("numbered", lambda x, y: x["last_turn"] == y["first_turn"]))
    span = F.element_at("numbered", -1)["last_turn"] - F.element_at("numbered", 1)["first_turn"] + 1
    gaps = F.when(F.size("numbered") > 0, span - (total("numbered", "n_turns") - again)).otherwise(F.lit(0)).cast("long")
    codes = F.array_join(F.transform("pieces", lambda p: p["codes"]), "")
    return df.select("conv", "pieces", gaps.alias("gaps"), (total("filled", "illegal") + meets).alias("illegal"), codes.alias("codes")).select(
        "conv", "pieces", "gaps", *_counts(F.col("codes")), "illegal", _signature(F.col("codes")).alias("signature")
    )


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of the distinct signatures; n: how often each occurs."""
    ddl = "signature string, n long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0, CHUNK_BYTES // 8):
            answers = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())], names=["signature", "n", "cost", "audit"])

    counted = signatures.groupBy("signature").agg(F.count("*").alias("n"))
    return saved(counted.mapInArrow(run, ddl), "signatures")


def _audited(df: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """``df`` with cost and audit of its signature: the frequent ones by broadcast, the rest by shuffle."""
    hot = F.broadcast(answers.where(F.col("n") * HOT_SIGNATURES > total).select(F.col("signature").alias("hot"), F.col("cost").alias("hot_cost"), F.col("audit").alias("hot_audit")))
    tried = df.join(hot, F.col("signature") == F.col("hot"), "left")
    done = tried.where("hot IS NOT NULL").select(*df.columns, F.col("hot_cost").alias("cost"), F.col("hot_audit").alias("audit"))
    rest = tried.where("hot IS NULL").select(*df.columns).join(answers.where(F.col("n") * HOT_SIGNATURES <= total).drop("n"), "signature")
    return done.unionByName(rest)


def _replayed(df: DataFrame) -> DataFrame:
    """``df`` (with turns, edits and state) with the edited turns in their place."""
    out = df.drop("edits", "state")
    schema = _arrow(out.schema, df.sparkSession)
    names, given = out.columns, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                columns = dict(zip(given, batch.columns, strict=True))
                turns = [replay(t, e, s)[0] for t, e, s in zip(columns["turns"].to_pylist(), columns["edits"].to_pylist(), columns["state"].to_pylist(), strict=True)]
                arrays = [pa.array(turns, schema.field("turns").type) if n == "turns" else columns[n] for n in names]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, out.schema)


def _pieces(df: DataFrame) -> DataFrame:
    """(conv, part, chunk, edits, state) of every chunk of (conv, pieces, audit)."""
    ddl = f"conv {df.schema['conv'].dataType.simpleString()}, part int, chunk int, edits string, state int"
    schema = _arrow(ddl, df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for at in range(whole.num_rows):
                conv, pieces, audit = (c[0].as_py() for c in whole.slice(at, 1).columns)
                begin, state = 0, 0
                for k, piece in enumerate(pieces):
                    end, left = begin, len(piece["codes"])
                    while left or (k == len(pieces) - 1 and end < len(audit)):
                        left -= audit[end] != "I"
                        end += 1
                    edits = audit[begin:end]
                    yield {"conv": conv, "part": piece["part"], "chunk": piece["chunk"], "edits": edits, "state": state}
                    turns = [{"role": {"u": "user", "a": "assistant", "s": "system"}.get(c.lower(), ""), "text": ""} for c in piece["codes"]]
                    state = replay(turns, edits, state)[1]
                    begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema, lambda r: 100 + len(r["edits"]))

    return df.mapInArrow(run, ddl)


def repair(turns: DataFrame, id_col: str = "conv_id", dropped: Column | None = None, chunk_turns: int = CHUNK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired) of the conversations in ``turns`` (id, turn, role, text).

    audits: (id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation.
    repaired: (id, part, chunk, whole, turns), the edited turns (role, text) in the order of (part,
    chunk); whole: the conversation has this chunk only.
    """
    cut = chunks(turns, id_col, dropped, chunk_turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    span = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(F.lit(0)).cast("long")
    whole = cut.where("whole").select("conv", "part", "chunk", "turns", span.alias("gaps"), *_counts(F.col("codes")), "illegal", _signature(F.col("codes")).alias("signature"))
    parted = saved(_across(cut.where("NOT whole")), "parted")
    summaries = saved(_summaries(parted), "summaries")
    answers = solved(whole.select("signature").unionByName(summaries.select("signature")))
    total = answers.agg(F.sum("n")).first()[0] or 0

    in_row = saved(_audited(whole, answers, total).withColumns({"edits": F.col("audit"), "state": F.lit(0)}).transform(_replayed), "repaired")
    long = saved(_audited(summaries, answers, total), "audits")
    pieces = _pieces(long.select("conv", "pieces", "audit")).withColumnsRenamed({"conv": "its", "part": "its_part", "chunk": "its_chunk"})
    same = F.col("conv").eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")) & (F.col("chunk") == F.col("its_chunk"))
    edited = _replayed(parted.select("conv", "part", "chunk", "turns").join(pieces, same).drop("its", "its_part", "its_chunk"))

    columns = [F.col("conv").alias(id_col), *counts, "cost", "audit"]
    audits = in_row.select(*columns).unionByName(long.select(*columns))
    out = [F.col("conv").alias(id_col), "part", "chunk"]
    repaired = in_row.select(*out, F.lit(True).alias("whole"), "turns").unionByName(edited.select(*out, F.lit(False).alias("whole"), "turns"))
    return audits, repaired


def _rendered() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256): the digest of each conversation's ``role:text`` lines.

    Chunks of longer conversations are hashed one after the other, in order, without being held together.
    """
    short = repaired.where("whole").select(id_col, F.sha2(_rendered().cast("binary"), 256).alias("repaired_sha256"))
    long = repaired.where("NOT whole").select(id_col, "part", "chunk", F.size("turns").alias("n"), _rendered().alias("text"))
    # A hash is one sequence, so a conversation's chunks meet in one task, which holds one of them at a time.
    long = long.repartition(id_col).sortWithinPartitions(id_col, "part", "chunk")
    schema = _arrow(short.schema, repaired.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, filled = None, None, False
        for whole in batches:
            for at in range(whole.num_rows):
                conv, _, _, n, text = (c[0].as_py() for c in whole.slice(at, 1).columns)
                if hashed is None or now != conv:
                    if hashed is not None:
                        yield pa.RecordBatch.from_pylist([{id_col: now, "repaired_sha256": hashed.hexdigest()}], schema)
                    now, hashed, filled = conv, hashlib.sha256(), False
                if n:
                    hashed.update((("\n" if filled else "") + text).encode())
                    filled = True
        if hashed is not None:
            yield pa.RecordBatch.from_pylist([{id_col: now, "repaired_sha256": hashed.hexdigest()}], schema)

    return short.unionByName(long.mapInArrow(run, short.schema))


def damage(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turn, role, text) with the faults that the query repairs; ``gone`` marks dropped rows.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?``, 3
    repeats it, 4 makes its role user; nulls are one space.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    df = convs.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 3, F.lit(2)).otherwise(F.lit(1))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def report(convs: DataFrame) -> DataFrame:
    """Audit, counts and digest of every damaged and repaired conversation."""
    audits, repaired = repair(damage(convs), "conv_id", F.col("gone"))
    found = digests(repaired).withColumnRenamed("conv_id", "its")
    return audits.join(found, F.col("conv_id").eqNullSafe(F.col("its"))).drop("its")


def _add(value: str, cost: str, edit: str) -> str:
    return f"lpad(cast(cast({value}[:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{edit}'"


#: Costs and audits so far by state, as text that sorts by cost and then by audit.
_INSERTED = f"v0, v1, least(v2, {_add('v0', '2', 'I')}, {_add('v1', '2', 'I')}, {_add('v3', '2', 'I')}) AS v2, least(v3, {_add('v2', '2', 'I')}) AS v3"
_STAYS = "CASE WHEN truncated THEN 1 ELSE 0 END"
_FITS = [f"CASE WHEN NOT lost AND role LIKE 'u%' THEN {_add(v, _STAYS, 'K')} END, CASE WHEN NOT lost THEN {_add(v, '2 + ' + _STAYS, 'R')} END" for v in ("v0", "v1", "v3")]
CRC_TABLE = "SELECT list(x ORDER BY n) AS t FROM " + "(SELECT n, xor(x >> 1, 3988292384 * (x & 1)) AS x FROM " * 8 + "(SELECT range AS n, range AS x FROM range(256))" + ")" * 8


def crc_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a text's UTF-8 bytes; ``t`` is the column of ``CRC_TABLE``."""
    octets = f"list_transform(range(0, cast(length(hex({text})) / 2 AS BIGINT)), lambda i: cast('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty FROM hurt
), coded AS (
  SELECT *, empty OR seen AS lost, NOT (empty OR seen) AND right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS truncated,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (seen AND NOT empty) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM coded GROUP BY conv_id
), best AS (
  SELECT conv_id, n, cast(0 AS BIGINT) AS i, '000000000' AS v0, cast(NULL AS VARCHAR) AS v1, cast(NULL AS VARCHAR) AS v2, cast(NULL AS VARCHAR) AS v3 FROM counted
  UNION ALL
  SELECT b.conv_id, n, b.i + 1, {_add('v0', '3', 'D')}, least({_add('v1', '3', 'D')}, CASE WHEN NOT lost AND role LIKE 's%' THEN {_add('v0', _STAYS, 'K')} END),
    least({_add('v2', '3', 'D')}, {', '.join(_FITS)}), least({_add('v3', '3', 'D')}, CASE WHEN NOT lost AND role LIKE 'a%' THEN {_add('v2', _STAYS, 'K')} END, CASE WHEN NOT lost THEN {_add('v2', '2 + ' + _STAYS, 'R')} END)
  FROM (SELECT conv_id, n, i, {_INSERTED} FROM (SELECT conv_id, n, i, {_INSERTED} FROM best WHERE i < n)) b JOIN coded c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = b.i + 1
), answer AS (
  SELECT conv_id, least(v0, v3) AS v FROM (SELECT conv_id, n, i, {_INSERTED} FROM (SELECT conv_id, n, i, {_INSERTED} FROM best WHERE i = n))
), edits AS (
  SELECT conv_id, e, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS nth
  FROM (SELECT conv_id, generate_subscripts(string_split(v[10:], ''), 1) AS e, unnest(string_split(v[10:], '')) AS edit FROM answer WHERE length(v) > 9)
  WINDOW w AS (PARTITION BY conv_id ORDER BY e)
), lines AS (
  SELECT e.conv_id, e.e, CASE WHEN edit = 'K' THEN role WHEN (nth - max(CASE WHEN edit = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM edits e LEFT JOIN coded c ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY e) AS t FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cast(v[:9] AS BIGINT), 0) AS cost, coalesce(v[10:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN answer a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""
