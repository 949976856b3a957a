"""Conversation structure repair at least cost, ties to the least audit string.

Rows of a conversation become a layered graph: node ``(i, q)`` stands before row i with
what was put out so far ending in q (nothing, system, user or assistant).  Arcs keep, rerole or
delete the row, or insert a row of empty text; a path from ``(0, nothing)`` to ``(n, nothing or
assistant)`` is a repair, its labels are the audit string.

A cost DP gives every node its least cost to the end; arcs that attain it are optimal.
Prefix doubling then ranks the nodes: round k ranks the least audit strings of length
``2 ** k`` by the pairs of ranks of round k - 1 at a node and at the node its pointer leads to,
and doubles the pointers.  The ranks select each node's arc, the doubled pointers give all
steps of the least path at once.

Scale: only flags and 128-bit text hashes take part until the repaired text is hashed.  Places
come from counted ranges.  Rows are solved in blocks of at most ``BLOCK``; a longer conversation
is several blocks, joined by their min-plus matrices (one of 16 numbers a block) from the end
and by their exits from the start, so a conversation with any share of the rows is many tasks,
and a task holds ``CHUNK + BLOCK`` rows at most.  First occurrences and neighbours are found by joins on
(conversation, place), which no conversation makes hot.  Only SHA-256 of the repaired text, a
sequence by definition, reads a conversation in one task, a row at a time, and its audit string is one value.

Nulls in role and text count as one space, and so do nulls in what the damage hashes; a null conversation id
is a conversation of its own; null turns come first.  Rows with one turn are ordered by role and text.
An empty role has no initial.  An empty table gives no rows.  Texts are read whole; columns
other than the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import partitions, placed, staged, table
from rostercast.llm.merkle_manifest import CRC32

BLOCK = 4096
CHUNK = 65_536
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed costs of the contract
SPACES = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the role that may follow each state
LABELS = b"\x00DIKR"  # in ASCII order; 0 ends a path
INF = 1 << 40
ACCEPT = np.array([0, 2 * INSERT, INSERT, 0])  # cost to the end from behind the last row


# --- damage and faults ------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``(c, conv_id, turn, role, text, copies)`` of the rows that stay, each as often as ``copies`` says."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select(conversation(), "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("c", "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def conversation() -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")


def faults(rows: DataFrame) -> DataFrame:
    """``(c, conv_id, turn, role, md5, idx, n, initial, fault, code, illegal)`` of every row; at most one fault, the first that holds.

    ``rows`` are as :func:`damaged` gives them.
    """
    ended = F.rtrim("text", F.lit(SPACES))
    thin = rows.select("c", "conv_id", "turn", "role", F.md5(F.col("text")).alias("md5"), (ended == "").alias("empty"),
                       (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    ordered = staged(placed(thin, "c", ["turn", "role", "md5"]), "turns")
    firsts = ordered.groupBy("c", "role", "md5").agg(F.min("idx").alias("idx")).select("c", "idx", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    before = ordered.select("c", (F.col("idx") + 1).alias("idx"), initial.alias("before"))
    marked = ordered.join(firsts, ["c", "idx"], "left").join(before, ["c", "idx"], "left").withColumn("initial", initial)
    fault = (F.when(F.col("empty"), F.lit("blank")).when(F.col("first").isNull(), F.lit("duplicate")).when(F.col("open"), F.lit("truncated")))
    code = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    return marked.select("c", "conv_id", "turn", "role", "md5", "idx", "n", fault.alias("fault"), code.alias("code"), illegal.alias("illegal"))


# --- the graph of many blocks at once -------------------------------------------------------------------

def cost_to_go(first: np.ndarray, length: np.ndarray, code: np.ndarray, banned: np.ndarray, extra: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from every node to its block's end: ``(rows + blocks, 4)``; row r of block s is node row ``r + s``.

    ``ends`` are the costs from behind each block's last row.
    """
    base = first + np.arange(len(first))
    cost = np.full((len(code) + len(first), 4), INF, np.int64)
    cost[base + length] = ends
    order = np.argsort(-length, kind="stable")
    longest = length[order]
    for j in range(1, int(longest[0]) + 1 if len(longest) else 0):
        live = order[:np.searchsorted(-longest, -j, side="right")]
        at = length[live] - j
        row, node = first[live] + at, base[live] + at
        cost[node] = before_row(cost[node + 1], code[row], banned[row], extra[row]).min(axis=2)
        for _ in range(3):  # inserts: at most nothing, user, assistant and one more
            cost[node] = np.minimum(cost[node], INSERT + cost[node][:, NEXT])
    return np.minimum(cost, INF)


def before_row(after: np.ndarray, code: np.ndarray, banned: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Cost through each arc over a row, ``(rows, 4 states, delete/keep/rerole)``, given the costs behind it."""
    out = np.full((*after.shape, 3), INF, np.int64)
    out[:, :, 0] = DELETE + after
    onward = after[:, NEXT]
    fits = code[:, None] == NEXT[None, :]
    out[:, :, 1] = np.where(fits, KEEP + extra[:, None] + onward, INF)
    out[:, 0, 1] = np.where(code == SYSTEM, KEEP + extra + after[:, SYSTEM], out[:, 0, 1])
    out[:, :, 2] = REROLE + extra[:, None] + onward
    out[:, :, 1:][banned] = INF
    return np.minimum(out, INF)


def least_arcs(first: np.ndarray, length: np.ndarray, code: np.ndarray, banned: np.ndarray, extra: np.ndarray,
               cost: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Optimal arcs of every node, ``(nodes, 4 labels)`` in ASCII order: the target, or -1.  Nodes are ``4 * (r + s) + q``."""
    blocks = np.repeat(np.arange(len(first)), length)
    node = np.arange(len(code)) + blocks
    target = np.full((len(cost), 4, 4), -1, np.int64)  # by node row, state, label D I K R
    through = before_row(cost[node + 1], code, banned, extra)
    good = (through == cost[node][:, :, None]) & (cost[node] < INF)[:, :, None]
    behind = 4 * (node + 1)[:, None]
    kept = np.where((code == SYSTEM)[:, None] & (np.arange(4) == NOTHING)[None, :], SYSTEM, NEXT[None, :])
    target[node, :, 0] = np.where(good[:, :, 0], behind + np.arange(4)[None, :], -1)
    target[node, :, 2] = np.where(good[:, :, 1], behind + kept, -1)
    target[node, :, 3] = np.where(good[:, :, 2], behind + NEXT[None, :], -1)
    ends = first + np.arange(len(first)) + length
    may = np.ones(len(cost), bool)
    may[ends[~last]] = False  # behind a block that is not the last stands the next one's first row
    inserts = may[:, None] & (cost < INF) & (cost == INSERT + cost[:, NEXT])
    target[:, :, 1] = np.where(inserts, 4 * np.arange(len(cost))[:, None] + NEXT[None, :], -1)
    return target.reshape(-1, 4)


def ranked_paths(target: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Prefix doubling: ``(pointers by power of two, label of each node's first step, steps to the end)``."""
    nodes = np.arange(len(target))
    has = target >= 0
    label = np.where(has.any(axis=1), has.argmax(axis=1) + 1, 0)
    # round 0: arcs of a node bear different labels, so its least audit of length 1 names one arc
    pointer = np.where(label > 0, target[nodes, np.maximum(label, 1) - 1], nodes)
    rank, steps, pointers, reach = label.copy(), (label > 0).astype(np.int64), [pointer], 1
    while reach < longest:
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
        reach *= 2
    # the arc of the least path: least label, then least rank of what follows
    order = np.where(has, np.arange(1, 5)[None, :] * (rank.max() + 1) + rank[np.maximum(target, 0)], np.iinfo(np.int64).max)
    chosen = np.where(has.any(axis=1), order.argmin(axis=1) + 1, 0)
    return pointers, chosen, steps


def solved(first, length, code, banned, extra, ends, last, starts_block, starts_state):
    """For each start: cost, audit, ops and exit state.

    Ops tell the steps with their roles: ``d`` deleted, ``k`` kept, ``u``/``a`` reroled, ``U``/``A`` inserted.
    """
    cost = cost_to_go(first, length, code, banned, extra, ends)
    target = least_arcs(first, length, code, banned, extra, cost, last)
    pointers, label, steps = ranked_paths(target, 2 * int(length.max(initial=0)) + 4)
    start = 4 * (first + np.arange(len(first)))[starts_block] + starts_state
    start_cost = cost.reshape(-1)[start]
    n = np.where(start_cost < INF, steps[start], 0)
    at = np.repeat(start, n)
    t = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    for k, pointer in enumerate(pointers):
        at = np.where(t >> k & 1, pointer[at], at)
    step, follows = label[at], NEXT[at % 4]
    audit = np.frombuffer(LABELS, np.uint8)[step].tobytes()
    roles = np.where(follows == USER, ord("u"), ord("a"))
    ops = np.select([step == 1, step == 2, step == 3], [ord("d"), roles - 32, ord("k")], roles).astype(np.uint8).tobytes()
    final = start
    for k, pointer in enumerate(pointers):
        final = np.where(n >> k & 1, pointer[final], final)
    cut = np.concatenate([[0], np.cumsum(n)])
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return start_cost, [audit[a:b].decode() for a, b in spans], [ops[a:b].decode() for a, b in spans], final % 4


# --- blocks through Spark -----------------------------------------------------------------------------

BLOCK_ROWS = ("c", "block", "last", "code", "banned", "extra", "ends")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole blocks, about ``CHUNK`` rows at a time, from sorted batches."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.to_pandas())
        rows += batch.num_rows
        if rows >= CHUNK:
            df = pd.concat(held, ignore_index=True)
            tail = df.index[(df["c"] != df["c"].iloc[-1]) | (df["block"] != df["block"].iloc[-1])]
            cut = tail[-1] + 1 if len(tail) else 0  # the block at the end may go on
            if cut:
                yield df.iloc[:cut].reset_index(drop=True)
            held, rows = [df.iloc[cut:]], len(df) - cut
    df = pd.concat(held, ignore_index=True) if held else None
    if df is not None and len(df):
        yield df


def arrays(df: pd.DataFrame):
    new = (df["c"] != df["c"].shift()) | (df["block"] != df["block"].shift())
    first = np.flatnonzero(new.to_numpy())
    length = np.diff(np.append(first, len(df)))
    return first, length, df["code"].to_numpy(np.int64), df["banned"].to_numpy(bool), df["extra"].to_numpy(np.int64)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(c, block, matrix)``: least cost from each state before a block to each behind it; to the end for the last."""
    for df in chunks(batches):
        first, length, code, banned, extra = arrays(df)
        last = df["last"].to_numpy(bool)[first]
        out = np.empty((len(first), 4, 4), np.int64)
        for q in range(4):
            ends = np.where(last[:, None], ACCEPT, np.where(np.arange(4) == q, 0, INF))
            cost = cost_to_go(first, length, code, banned, extra, ends)
            out[:, :, q] = cost[first + np.arange(len(first))]
        yield pa.RecordBatch.from_pydict({"c": pa.array(df["c"].iloc[first]), "block": pa.array(df["block"].iloc[first]),
                                          "last": pa.array(last), "matrix": pa.array(out.reshape(-1, 16).tolist(), pa.list_(pa.int64()))})


def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cost to the end from behind every block of a conversation; a row for ``BLOCK`` rows."""
    pdf = pdf.sort_values("block", ascending=False)
    cost, out = ACCEPT, []
    for m, last in zip(pdf["matrix"], pdf["last"], strict=True):
        out.append(cost.tolist())
        m = np.asarray(m, np.int64).reshape(4, 4)
        cost = m[:, 0] if last else np.minimum((m + cost[None, :]).min(axis=1), INF)
    return pd.DataFrame({"c": pdf["c"], "block": pdf["block"], "ends": out})


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(c, block, state, cost, audit, ops, exit)`` for every state a block may be entered in."""
    for df in chunks(batches):
        first, length, code, banned, extra = arrays(df)
        heads = df.iloc[first]
        last = heads["last"].to_numpy(bool)
        ends = np.array([ACCEPT if z else e for z, e in zip(last, heads["ends"], strict=True)], np.int64).reshape(-1, 4)
        inner = np.flatnonzero(heads["block"].to_numpy() > 0)
        starts = np.concatenate([np.arange(len(first)), np.repeat(inner, 3)])
        states = np.concatenate([np.zeros(len(first), np.int64), np.tile([SYSTEM, USER, ASSISTANT], len(inner))])
        cost, audit, ops, final = solved(first, length, code, banned, extra, ends, last, starts, states)
        yield pa.RecordBatch.from_pydict({"c": pa.array(heads["c"].iloc[starts]), "block": pa.array(heads["block"].iloc[starts]),
                                          "state": pa.array(states.astype(np.int32)), "cost": pa.array(cost), "audit": pa.array(audit),
                                          "ops": pa.array(ops), "exit": pa.array(final.astype(np.int32))})


def entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which the least path enters every block of a conversation."""
    exits = {(b, q): x for b, q, x in zip(pdf["block"], pdf["state"], pdf["exit"], strict=True)}
    state, out = NOTHING, []
    for b in range(int(pdf["block"].max()) + 1):
        out.append(state)
        state = exits[b, state]
    return pd.DataFrame({"c": pdf["c"].iloc[0], "block": np.arange(len(out)), "state": out})


def repaired(rows: DataFrame) -> DataFrame:
    """``(c, block, cost, audit, ops)`` of the least path of every conversation, ``rows`` as :func:`faults` gives them."""
    spark = rows.sparkSession
    ready = rows.select("c", F.expr(f"idx div {BLOCK}").alias("block"), F.expr(f"idx div {BLOCK} = (n - 1) div {BLOCK}").alias("last"), "idx", "n", "code",
                        F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("banned"),
                        F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"))

    def by_block(df: DataFrame) -> DataFrame:
        return (df.repartition(partitions(spark), "c", "block").sortWithinPartitions("c", "block", "idx").select(*BLOCK_ROWS))

    long = ready.where(f"n > {BLOCK}")
    some = not long.isEmpty()
    none = F.lit(None).cast("array<bigint>").alias("ends")
    if some:
        matrix = by_block(long.withColumn("ends", none)).mapInArrow(matrices, "c string, block long, last boolean, matrix array<long>")
        ends = staged(matrix.groupBy("c").applyInPandas(ends_of, "c string, block long, ends array<long>"), "block-ends")
        ready = ready.join(ends, ["c", "block"], "left")
    else:
        ready = ready.withColumn("ends", none)
    found = staged(by_block(ready).mapInArrow(paths, "c string, block long, state int, cost long, audit string, ops string, exit int"), "paths")
    if not some:
        return found
    several = found.where("block > 0").select("c").distinct()
    states = found.join(several, "c", "left_semi").select("c", "block", "state", "exit").groupBy("c").applyInPandas(entered, "c string, block long, state int")
    alone = found.join(several, "c", "left_anti")
    return alone.unionByName(found.join(states, ["c", "block", "state"]).select(*found.columns))


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(c, repaired_sha256)`` from sorted lines of conversations, a line at a time."""
    c, place, state = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"c": [c], "repaired_sha256": [state.hexdigest()]})

    out: list[tuple[str, str]] = []
    for batch in batches:
        for key, idx, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != c:
                if state is not None:
                    out.append((c, state.hexdigest()))
                c, place, state = key, None, hashlib.sha256()
            if idx == place:
                continue  # a row of the table that stands there more than once
            state.update((b"" if place is None else b"\n") + line.encode())
            place = idx
        if out:
            yield pa.RecordBatch.from_pydict({"c": pa.array([k for k, _ in out], pa.string()), "repaired_sha256": pa.array([h for _, h in out], pa.string())})
            out = []
    if state is not None:
        yield done()


def repaired_rows(rows: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """``(c, idx, line)``: the ``role:text`` lines that a row becomes, with the lines inserted before it."""
    steps = found.select("c", "block", F.posexplode(F.regexp_extract_all("ops", F.lit("[UA]*[dkua]|[UA]+$"), F.lit(0))).alias("p", "op"))
    steps = steps.where("op <> 'd'").select("c", (F.col("block") * BLOCK + F.col("p")).alias("idx"), "op")
    # of rows with one role and text only the first may stay, so these keys name one place
    keys = ["c", "turn", "role", "md5"]
    kept = steps.join(marked.select(*keys, "idx"), ["c", "idx"], "left")
    texts = rows.select("c", "turn", "role", F.md5(F.col("text")).alias("md5"), "text")
    joined = kept.alias("k").join(texts.alias("t"), (F.col("k.c") == F.col("t.c")) & F.col("k.turn").eqNullSafe(F.col("t.turn"))
                                  & (F.col("k.role") == F.col("t.role")) & (F.col("k.md5") == F.col("t.md5")), "left")
    last = F.right(F.col("k.op"), F.lit(1))
    role = F.when(last == "k", F.col("k.role")).when(last == "u", F.lit("user")).when(last == "a", F.lit("assistant"))
    inserted = F.expr("transform(filter(split(k.op, ''), x -> x in ('U', 'A')), x -> if(x = 'U', 'user:', 'assistant:'))")
    return joined.select(F.col("k.c").alias("c"), F.col("k.idx").alias("idx"), F.array_join(F.concat(inserted, F.array_compact(F.array(
        F.concat(role, F.lit(":"), F.col("t.text"))))), "\n").alias("line"))


def repair(conversations: DataFrame) -> DataFrame:
    """A report for every conversation: its faults, the least cost, the audit string and the hash of the repaired text."""
    n = partitions(conversations.sparkSession)
    rows = damaged(conversations)
    marked = staged(faults(rows), "marked")
    found = staged(repaired(marked), "repairs")
    lines = repaired_rows(rows, marked, found)
    sha = lines.repartition(n, "c").sortWithinPartitions("c", "idx").mapInArrow(hashes, "c string, repaired_sha256 string")
    report = marked.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if("illegal").alias("illegal"))
    audits = found.groupBy("c").agg(F.min(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
                                    F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    every = conversations.select(conversation(), "conv_id").distinct()
    out = every.join(report, "c", "left").join(audits, "c", "left").join(sha, "c", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


# Rows one after the other, the best (cost, audit, text) for each state.  Inserts are left out: without an inserted row
# and its neighbour, deleted for 2, a repair costs at least 3 less, so none is ever on a least path.
_OPS = {"keep": "{{'c': {s}.c + x, 'a': {s}.a || 'K', 't': {s}.t || nl || role || ':' || text}}",
        "user": "{{'c': {s}.c + x + 1, 'a': {s}.a || 'R', 't': {s}.t || nl || 'user:' || text}}",
        "assistant": "{{'c': {s}.c + x + 1, 'a': {s}.a || 'R', 't': {s}.t || nl || 'assistant:' || text}}"}


def _state(q: str, arcs: list[tuple[str, str, str]]) -> str:
    parts = [f"{{'c': {q}.c + 2, 'a': {q}.a || 'D', 't': {q}.t}}"]
    parts += [f"CASE WHEN NOT banned AND {cond} THEN {_OPS[op].format(s=s)} END" for s, op, cond in arcs]
    return f"list_min(list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL)) AS {q}"


_FROM = lambda sources, role: [(s, op, cond) for s in sources for op, cond in (("keep", f"ini = '{role[0]}'"), (role, "true"))]
SQL = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {CRC32.format('k')} % 20 AS kind FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS cp
  FROM kinds WHERE kind <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), cp) - 1 AS i, role[1] AS ini FROM dam),
flt AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ord),
rows AS (SELECT *, body = '' AS blank, body <> '' AND seen AS duplicate, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM flt),
arcs AS (SELECT conv_id, i, role, text, ini, blank OR duplicate AS banned, CASE WHEN truncated THEN 5 ELSE 0 END AS x, chr(10) AS nl FROM rows),
dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS e, {{'c': 1000000, 'a': '', 't': ''}} AS s, {{'c': 1000000, 'a': '', 't': ''}} AS u,
  {{'c': 1000000, 'a': '', 't': ''}} AS a FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL SELECT dp.conv_id, dp.i + 1, {_state('e', [])}, {_state('s', [('e', 'keep', "ini = 's'")])},
  {_state('u', _FROM('esa', 'user'))}, {_state('a', _FROM('u', 'assistant'))}
  FROM dp JOIN arcs ON arcs.conv_id IS NOT DISTINCT FROM dp.conv_id AND arcs.i = dp.i),
best AS (SELECT dp.conv_id, least(e, a) AS b FROM dp JOIN (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id) z
  ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.n = dp.i),
rep AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
  count_if(truncated) AS truncated, count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""
