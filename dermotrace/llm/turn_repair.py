"""Operator 12: repair of conversation structure by a min-plus matrix scan.

The roles of a conversation should be nothing, or an optional system turn and then user and assistant in turn: an
automaton of four states. Each turn is a 4 x 4 matrix whose elements are the cheapest edits (cost, audit) that lead from
one state to another: keep it, give it another role or delete it, with any inserted turns before and after (the closure
of inserting). The product takes, over the states between, the least (cost, audit); it is associative, so a run of turns
is multiplied as a balanced tree, and so are the runs of a conversation that lies in several tasks, ``FAN`` at a time.
The least element that leads from the start to an accepted state is the answer. Audits of one cost never begin one
another (an inserted turn more costs more), so the least of the whole has the least parts.

Turns are dealt by ranges of (conv_id, turn) and read in order; a task keeps ``RUN`` turns at most before it emits their
product. Repeated turns are found by grouping on a digest of (role, text). Only writing the repaired turns brings a
conversation's texts to one task, one after another, and its audit, which is part of the result.

Null roles and texts are one space: such a text is blank, such a role none of the three. Tied turns are in the order of
the digest of role and text; of equal rows all but the first are duplicates. Rows with a null conv_id are one
conversation with a null id. A role counts by its first character. Turns that don't end a sentence count as truncated
whatever their length; texts may be of any length. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, scratch
from .turns import CRC_TABLE, crc32, crc_sql, kept, turn_key

#: Turns of a run and runs multiplied at a time.
RUN, FAN = 4096, 16
#: Costs of edits, white space, ends of sentences.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
ROLES = {"u": "user", "a": "assistant"}

_FAR = 1 << 60
#: State -> state by a turn of that initial: start, after system, after user, after assistant. Accepted: start, assistant.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
Matrix = tuple[tuple[int, str], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for p in (0, 4, 8, 12):
        for q in range(4):
            costs = [a[p + r][0] + b[4 * r + q][0] for r in range(4)]
            least = min(costs)
            out.append((_FAR, "") if least >= _FAR else (least, min(a[p + r][1] + b[4 * r + q][1] for r in range(4) if costs[r] == least)))
    return tuple(out)


def _matrix(moves: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    return tuple(min(moves.get((p, q), [(_FAR, "")])) for p in range(4) for q in range(4))


def closure() -> Matrix:
    """No inserted turn, or user and assistant in turn: after two of them a state comes again, so that more never pay."""
    moves = {(p, p): [(0, "")] for p in range(4)}
    for p in range(4):
        q = p
        for n in (1, 2):
            q = STEPS["u"].get(q, STEPS["a"].get(q))
            moves.setdefault((p, q), []).append((n * INSERT, "I" * n))
    return _matrix(moves)


@lru_cache(None)
def turn_matrix(symbol: str) -> Matrix:
    """A symbol is the initial of the role, in upper case for a truncated turn, or ``-`` for one that has to go."""
    moves = {(p, p): [(DELETE, "D")] for p in range(4)}
    if symbol != "-":
        more = TRUNCATED if symbol.isupper() else 0
        for p, q in STEPS.get(symbol.lower(), {}).items():
            moves.setdefault((p, q), []).append((more, "K"))
        for by in ROLES:
            for p, q in STEPS[by].items():
                moves.setdefault((p, q), []).append((REROLE + more, "R"))
    return product(product(closure(), _matrix(moves)), closure())


@lru_cache(8192)
def _short(symbols: str) -> Matrix:
    return turn_matrix(symbols) if len(symbols) == 1 else product(_short(symbols[: len(symbols) // 2]), _short(symbols[len(symbols) // 2 :]))


def scan(symbols: str) -> Matrix:
    """The product of one or more turns, as a balanced tree."""
    n = len(symbols)
    return _short(symbols) if n <= 64 else product(scan(symbols[: n // 2]), scan(symbols[n // 2 :]))


_SUMS = ("n", "blank", "duplicate", "truncated", "illegal")
_FIELDS = {"conv_id": pa.int64(), "part": pa.int64(), "whole": pa.bool_(), **dict.fromkeys(_SUMS, pa.int64()), "head": pa.string(), "tail": pa.string(), "first_turn": pa.int64(), "last_turn": pa.int64(), "n_turns": pa.int64(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
_SCHEMA = pa.schema(_FIELDS)
RUNS = "conv_id long, part long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, last_turn long, n_turns long, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


class _Run:
    """Turns of a conversation that follow one another."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.blank, self.duplicate, self.truncated, self.illegal = conv_id, [], 0, 0, 0, 0
        self.head, self.tail, self.first, self.last, self.n_turns = "", "", None, None, 0

    def add(self, turn, initial: str, fault: str) -> None:
        if self.symbols:
            self.illegal += self.tail + initial not in _LEGAL
        else:
            self.head = initial
        self.tail = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.n_turns = turn if self.first is None else self.first, turn, self.n_turns + 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.symbols.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)

    def row(self, part: int, whole: bool) -> dict:
        m = scan("".join(self.symbols))
        return {"conv_id": self.conv_id, "part": part, "whole": whole, "n": len(self.symbols), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail, "first_turn": self.first, "last_turn": self.last, "n_turns": self.n_turns, "costs": [c for c, _ in m], "audits": [a for _, a in m]}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's turns in order as runs; a conversation that neither begins nor ends the task and fits a run is whole."""
    part = TaskContext.get().partitionId() << 33
    run, out, n, inner = None, [], 0, False
    for batch in batches:
        for conv_id, turn, initial, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies")), strict=True):
            if run is None or run.conv_id != conv_id:
                if run is not None:
                    out.append(run.row(part + n, inner))
                    n += 1
                    inner = True
                run = _Run(conv_id)
            for i in range(copies):
                if len(run.symbols) >= RUN:
                    out.append(run.row(part + n, False))
                    n += 1
                    run, inner = _Run(conv_id), False
                run.add(turn, initial, fault if not i or fault == "blank" else "duplicate")
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            out = []
    if run is not None:
        yield pa.RecordBatch.from_pylist([run.row(part + n, False)], _SCHEMA)


def _joined(table: pa.Table) -> pa.Table:
    """Up to ``FAN`` runs of a conversation as one."""
    rows = sorted(table.select(list(_FIELDS)).to_pylist(), key=lambda r: r["part"])
    matrices = [tuple(zip(r["costs"], r["audits"], strict=True)) for r in rows]
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    out = dict(rows[0])
    for r in rows[1:]:
        for k in _SUMS:
            out[k] += r[k]
        out["illegal"] += out["tail"] + r["head"] not in _LEGAL
        out["n_turns"] += r["n_turns"] - (r["n_turns"] > 0 and out["last_turn"] == r["first_turn"])
        out["first_turn"] = r["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out |= {"tail": r["tail"], "last_turn": out["last_turn"] if r["last_turn"] is None else r["last_turn"]}
    out |= {"costs": [c for c, _ in matrices[0]], "audits": [a for _, a in matrices[0]]}
    return pa.Table.from_pylist([out], _SCHEMA)


def _filled(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def plans(conversations: DataFrame, folder: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of (conv_id, turn, role, text)."""
    rows = _filled(conversations)
    bare = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.length(bare) == 0, "blank").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated").otherwise("")
    rows = rows.select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.when(initial.isin(*STEPS), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    equal = rows.groupBy("conv_id", "turn", "key", "initial", "fault").agg(F.count("*").alias("copies"))
    first = equal.groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("t")).select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("t.turn").alias("t"))
    seen = equal.join(first, equal.conv_id.eqNullSafe(first.c) & (equal.key == first.k) & equal.turn.eqNullSafe(first.t), "left")
    turns = seen.select("conv_id", "turn", "key", "initial", F.when(F.col("k").isNull() & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault")).alias("fault"), "copies")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    runs = kept(dealt.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(_runs, RUNS), folder, "runs")

    done, some = runs.where("whole"), runs.where("not whole")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    most, level = some.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1, 0
    while most > 1:
        group = some.withColumn("group", F.floor(place / FAN).cast("long"))
        some = kept(group.groupBy("conv_id", "group").applyInArrow(_joined, RUNS), folder, f"joined{level}")
        most, level = -(-most // FAN), level + 1
    best = F.least(*(F.struct(F.get("costs", i).alias("cost"), F.get("audits", i).alias("audit")) for i in (0, 3)))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    out = done.unionByName(some).withColumn("best", best)
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def _walked(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, in order, in one task."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = _filled(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), "role", "text")
    heads = audits.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("binary").alias("key"), none("string").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows).repartition(partitions(conversations.sparkSession), "conv_id")
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "key").select("conv_id", "kind", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch, (conv_id, role, text) of the repaired turns and, after a conversation's last, (conv_id, None, None)."""
    conv_id, audit, at, state, open_ = None, "", 0, 0, False
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = 3 if state == 2 else 2
            out.append((conv_id, "assistant" if state == 3 else "user", ""))
            at += 1

    for batch in batches:
        for c, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")), strict=True):
            if not kind:
                if open_:
                    inserted()
                    out.append((conv_id, None, None))
                conv_id, audit, at, state, open_ = c, text, 0, 0, True
                continue
            inserted()
            if audit[at] == "K":
                state = STEPS[role[0]][state]
                out.append((c, role, text))
            elif audit[at] == "R":
                state = 3 if state == 2 else 2
                out.append((c, "assistant" if state == 3 else "user", text))
            at += 1
        yield out
        out.clear()
    if open_:
        inserted()
        out.append((conv_id, None, None))
        yield out


def repaired_turns(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the repaired conversations, turns from 0; ``audits`` has (conv_id, audit)."""

    def run(batches):
        turn = 0
        for rows in _edited(batches):
            made = []
            for c, role, text in rows:
                if role is not None:
                    made.append((c, turn, role, text))
                turn = 0 if role is None else turn + 1
            columns = list(zip(*made, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "turn", "role", "text"])

    return _walked(conversations, audits).mapInArrow(run, "conv_id long, turn long, role string, text string")


def repaired_digests(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the repaired ``role:text``, newline-joined, hashed as a stream."""

    def run(batches):
        state, begun = hashlib.sha256(), False
        for rows in _edited(batches):
            ids, sums = [], []
            for c, role, text in rows:
                if role is None:
                    ids.append(c)
                    sums.append(state.hexdigest())
                    state, begun = hashlib.sha256(), False
                else:
                    state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

    return _walked(conversations, audits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by the CRC-32 of ``conv_id:turn``, modulo 20: dropped, emptied, without ends, repeated, role user."""
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = _filled(conversations).withColumn("k", crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).where("k != 0")
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "repair")
    every = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = damaged(every)
    found = kept(plans(rows, folder), folder, "plans")
    sums = repaired_digests(rows, found.select("conv_id", "audit"))
    ids = every.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(found.conv_id), "left").drop("conv_id")
    out = out.join(sums, F.col("id").eqNullSafe(sums.conv_id), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _least(of: list[tuple]) -> str:
    """The least of (condition, state, cost, audit, turns) as a struct of SQL."""
    return "list_min([" + ", ".join(f"{{'c': CASE WHEN {when} THEN v[{p}].c + {cost} ELSE 1000000000 END, 'a': v[{p}].a || '{a}', 't': {t.format(p=p)}}}" for when, p, cost, a, t in of) + "])"


def _sql() -> str:
    keep = lambda p, initial: (f"NOT gone AND initial = '{initial}'", p, "cut", "K", "list_append(v[{p}].t, role || ':' || text)")
    rerole = lambda p, role: ("NOT gone", p, f"{REROLE} + cut", "R", f"list_append(v[{{p}}].t, '{role}:' || text)")
    drop = lambda p: ("true", p, str(DELETE), "D", "v[{p}].t")
    insert = lambda p, role: ("true", p, str(INSERT), "I", f"list_append(v[{{p}}].t, '{role}:')")
    stay = lambda p: ("true", p, "0", "", "v[{p}].t")
    moved = [[drop(1)], [drop(2), keep(1, "s")], [drop(3), *(keep(p, "u") for p in (1, 2, 4)), *(rerole(p, "user") for p in (1, 2, 4))], [drop(4), keep(3, "a"), rerole(3, "assistant")]]
    once = [[stay(1)], [stay(2)], [stay(3), insert(1, "user"), insert(2, "user"), insert(4, "user")], [stay(4), insert(3, "assistant")]]
    row = lambda of: "[" + ", ".join(map(_least, of)) + "]"
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("w")} % 20 AS k
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations), crc_table),
x AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) WHERE k <> 0),
y AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM x),
z AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd FROM y),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
  FROM z GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {row(once)} AS v
  FROM (SELECT conv_id, {row(once)} AS v FROM (SELECT conv_id, [{{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {none}, {none}, {none}] AS v FROM s))
  UNION ALL
  SELECT conv_id, i, {row(once)} AS v FROM (SELECT conv_id, i, {row(once)} AS v FROM (
    SELECT z.conv_id, z.i, {row(moved)} AS v
    FROM walk JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT * {TRUNCATED} AS cut FROM z) AS z ON z.conv_id IS NOT DISTINCT FROM walk.conv_id AND z.i = walk.i + 1))),
e AS (SELECT s.*, list_min([v[1], v[4]]) AS best FROM s JOIN walk ON walk.conv_id IS NOT DISTINCT FROM s.conv_id AND walk.i = s.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
