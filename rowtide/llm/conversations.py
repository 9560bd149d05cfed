"""Conversation structure repair by a rank-compressed dynamic program.

Turns are kept (K, free), given another role (R, 2), deleted (D, 3; a must for blank and
repeated ones) or inserted (I, 2, with an empty text) until the initials of the roles
read ``(s?(ua)+)?``; a truncated turn that stays costs 1.  Of the cheapest audits, the
edits' initials in order, the least in ASCII is taken.

A macro edit is a run of inserts and the edit of one turn: ``K``, ``IR``, ``IID`` ...
These nine codes are prefix-free and ordered, so after the same number of turns audits
compare by (rank of what came before, code), and no audit is ever built: a layer holds,
for each of four states (nothing yet, after s, after u, after a), the cost, the rank
among the layer's states, and the parent with its code, a byte.  The audit is
reconstructed from these once the last layer is known.

Only a slim table, without texts, is sorted: by range over (conversation, turn), so a
conversation with very many turns is split over partitions.  A partition's first and
last conversation may go on in others; a first pass gives for those pieces the cost and
rank of each way from a state to a state (16 of each), the driver chains the at most two
pieces of each partition, and a second pass reconstructs every piece by itself.  Texts
meet their turns only afterwards, and only where whole turns are asked for.

Defined results: a null role or text is one space (so blank, or a role to be replaced); a
null turn sorts first, turns of one number by role, then by the hash of their text; a
null conversation is a conversation; equal rows are counted, not gathered, and all but
the first are duplicates; roles that do not begin with s, u or a (an empty role, say)
cannot be kept; texts of any length are only read once for their end and their hash; an
empty table gives empty ones; columns but conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1

# --- the automaton ------------------------------------------------------------------

#: States: nothing yet, after s, after u, after a.  What may be inserted there, and where that leads.
START, S, U, A = range(4)
NEXT = {START: ("u", U), S: ("u", U), U: ("a", A), A: ("u", U)}
#: Macro edits in ASCII order; longer runs of inserts only come back to a state that is cheaper without.
CODES = sorted("I" * run + turn for run in range(3) for turn in "DKR")
ROLE = {"s": "system", "u": "user", "a": "assistant"}
INITIAL = {"": 0, "s": 1, "u": 2, "a": 3}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 40


def _after(state: int, run: int) -> tuple[str, int]:
    said = ""
    for _ in range(run):
        one, state = NEXT[state]
        said += one
    return said, state


def _transitions() -> list[tuple[int, int, int, np.ndarray]]:
    """(from, code, to, cost by kind of turn), ordered by where they lead; a kind is initial + 4 * fault."""
    found = []
    for p in range(4):
        for c, code in enumerate(CODES):
            run, turn = len(code) - 1, code[-1]
            said, here = _after(p, run)
            one, there = NEXT[here]
            ways = [("", here)] if turn == "D" else [(one, there)] + [("s", S)] * (turn == "K" and here == START)
            for emitted, to in ways:
                cost = np.full(16, NEVER)
                for kind in range(16):
                    initial, fault = kind % 4, kind // 4
                    unfinished = UNFINISHED * (fault == TRUNCATED)
                    if turn == "D":
                        cost[kind] = INSERT * run + DELETE
                    elif fault not in (BLANK, DUPLICATE) and (turn == "R" or initial == INITIAL[emitted]):
                        cost[kind] = INSERT * run + (REROLE if turn == "R" else KEEP) + unfinished
                found.append((p, c, to, cost))
    return sorted(found, key=lambda t: t[2])


_FOUND = _transitions()
FROM, CODE, TO = (np.array([t[i] for t in _FOUND]) for i in range(3))
COST = np.stack([t[3] for t in _FOUND], axis=1)
FIRST = np.searchsorted(TO, np.arange(4))
#: Inserts that end a conversation: none where it may end, else as many as lead to an a.
ENDING = {START: 0, A: 0, U: 1, S: 2}


def layers(kinds: np.ndarray, first: np.ndarray, n: np.ndarray, entries: tuple[int, ...] = (START,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The program over runs of turns, all at once, layer by layer.

    ``n`` falls.  Gives cost and rank of (run, entry, state), and layer after layer the
    parents (state + 4 * code) of the runs that are so long: a byte for each of a turn's
    ways.
    """
    cost = np.full((len(n), len(entries), 4), NEVER)
    rank = np.zeros(cost.shape, np.int64)
    for e, s in enumerate(entries):
        cost[:, e, s] = 0
    parents, at = np.empty((int(n.sum()), len(entries), 4), np.uint8), 0
    for i in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -i))  # runs with more than i turns
        total = np.minimum(cost[:k][:, :, FROM] + COST[kinds[first[:k] + i]][:, None, :], NEVER)
        best = np.minimum.reduceat(total << 8 | (rank[:k][:, :, FROM] * len(CODES) + CODE) << 2 | FROM, FIRST, axis=2)
        cost[:k] = best >> 8
        audit = np.where(cost[:k] < NEVER, best >> 2 & 63, 63)
        rank[:k] = (audit[..., None, :] < audit[..., :, None]).sum(axis=-1)
        parents[at : at + k] = best & 3 | (audit % len(CODES)) << 2
        at += k
    return cost, rank, parents


def ending(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state in which each run (…, state) had best end: cheapest, then the least audit."""
    inserts = np.array([ENDING[s] for s in range(4)])
    return ((np.minimum(cost, NEVER) + INSERT * inserts) << 8 | rank << 2 | inserts).argmin(axis=-1)


def back(parents: np.ndarray, n: np.ndarray, entry: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before, code) of every turn, run by run, of the paths that end in ``state``."""
    first = np.cumsum(n) - n
    before, codes = np.zeros(int(n.sum()), np.int8), np.zeros(int(n.sum()), np.int8)
    state, at = state.copy(), len(parents)
    for i in range((int(n[0]) if len(n) else 0) - 1, -1, -1):
        k = int(np.searchsorted(-n, -i))
        at -= k
        found = parents[at : at + k][np.arange(k), entry[:k], state[:k]]
        state[:k] = found & 3
        before[first[:k] + i], codes[first[:k] + i] = found & 3, found >> 2
    return before, codes


def chained(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(state it begins with, state it ends with) of each piece of one conversation, from their costs and ranks."""
    cost, rank, came = np.array([0, NEVER, NEVER, NEVER]), np.zeros(4, np.int64), []
    for c, r in pieces:
        total = np.minimum(cost[:, None] + c, NEVER) << 8 | (rank[:, None] * 4 + r) << 2 | np.arange(4)[:, None]
        best = total.min(axis=0)
        cost = best >> 8
        audit = np.where(cost < NEVER, best >> 2 & 63, 63)
        rank = (audit[None, :] < audit[:, None]).sum(axis=1)
        came.append(best & 3)
    state, found = int(ending(cost, rank)), []
    for parent in reversed(came):
        found.append((int(parent[state]), state))
        state = int(parent[state])
    return found[::-1]


# --- rows ---------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after a reproducible damage, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it a user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(told("role"))
    one = rows.select("conv_id", "turn", "role", "text", draw.alias("draw")).where("draw <> 0")
    done = one.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("times"))
    return done.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def _filled(rows: DataFrame) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", told("role"), told("text")).withColumn("th", F.unhex(F.md5("text")))


TURN = ("conv_id", "turn", "role", "th")


def _joined(a: DataFrame, b: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
    """``a`` with the other columns of ``b`` where ``columns`` are alike, nulls too."""
    other = b.select(*[F.col(c).alias(f"__{c}" if c in columns else c) for c in b.columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(other, same, how).drop(*[f"__{c}" for c in columns])


def skeleton(rows: DataFrame) -> DataFrame:
    """The distinct turns without their texts, in order: TURN, n (equal rows) and kind; written to the shared folder."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = _filled(rows).select(*TURN, F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE).alias("fault"))
    turns = slim.groupBy(*TURN, "fault").agg(F.count("*").alias("n"))
    # The earliest of the turns with one role and text; keys on both sides are distinct, so no join key is hot.
    first = turns.groupBy("conv_id", "role", "th").agg(F.min(F.struct(F.col("turn").isNotNull().alias("t"), "turn")).alias("f"))
    first = first.select("conv_id", F.col("f.turn").alias("turn"), "role", "th", F.lit(1).alias("first"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    initial = F.coalesce(*[F.when(F.startswith("role", F.lit(c)), k) for c, k in INITIAL.items() if c], F.lit(0))
    known = _joined(turns, first, TURN, "left").select(*TURN, "n", (initial + 4 * fault).cast("int").alias("kind"))
    order = [F.col(c).asc_nulls_first() for c in TURN]
    return cut(known.repartitionByRange(*order).sortWithinPartitions(*order))


#: Pairs of initials that may stand next to each other.
_LEGAL = np.zeros((4, 4), bool)
for _x, _y in ("su", "ua", "au"):
    _LEGAL[INITIAL[_x], INITIAL[_y]] = True


def _runs(ids: pa.ChunkedArray) -> np.ndarray:
    """Where conversations begin, and the end."""
    at = pa.chunked_array([ids.combine_chunks()]).dictionary_encode(null_encoding="encode").chunk(0).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([np.flatnonzero(np.diff(at, prepend=-1)), [len(at)]])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Stretches of whole runs of a sorted partition; with each, whether it is the first and whether the last."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
            if held.column("conv_id")[0].equals(table.column("conv_id")[-1]):
                held = table  # a run that goes on
                continue
        at = int(_runs(table.column("conv_id"))[-2])
        if at:
            yield table.slice(0, at), first, False
            first = False
        held = table.slice(at)
    if held is not None:
        yield held, first, True


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in columns]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last run of a partition: costs and ranks from every state to every state."""
    part, out = TaskContext.get().partitionId(), []
    for table, first, last in _closed(batches):
        starts = _runs(table.column("conv_id"))
        for r in sorted(({0} if first else set()) | ({len(starts) - 2} if last else set())):
            low, high = int(starts[r]), int(starts[r + 1])
            (kinds,) = _numbers(table.slice(low, high - low), "kind")
            cost, rank, _ = layers(kinds, np.zeros(1, np.int64), np.array([len(kinds)]), (START, S, U, A))
            out.append((table.column("conv_id")[low], part, bool(first and r == 0), bool(last and r == len(starts) - 2), cost[0].tobytes(), rank[0].tobytes(), int(kinds[-1]) % 4))
    if out:
        columns = [pa.array([o[0].as_py() for o in out], out[0][0].type)] + [pa.array(c) for c in [*zip(*out)][1:]]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "is_first", "is_last", "cost", "rank", "initial"])


def _plan(turns: DataFrame) -> dict[tuple[int, bool], tuple[int, int, bool, int | None]]:
    """How the pieces of split conversations go together: (part, its first run?) -> entry, exit, last piece, initial before.

    The driver sees at most two pieces of a partition, some 300 bytes each.
    """
    shape = f"conv_id {dict(turns.dtypes)['conv_id']}, part long, is_first boolean, is_last boolean, cost binary, rank binary, initial long"
    seen = sorted(turns.mapInArrow(_edges, shape).collect(), key=lambda r: (r.part, not r.is_first))
    chains: list[list] = []
    for r in seen:
        before = chains[-1][-1] if chains else None
        if before is not None and before.is_last and r.is_first and before.part != r.part and before.conv_id == r.conv_id:
            chains[-1].append(r)
        else:
            chains.append([r])
    plan = {}
    for chain in chains:
        if len(chain) < 2:
            continue
        ways = chained([tuple(np.frombuffer(x, np.int64).reshape(4, 4) for x in (r.cost, r.rank)) for r in chain])
        for k, (r, way) in enumerate(zip(chain, ways)):
            plan[r.part, r.is_first] = (*way, k == len(chain) - 1, chain[k - 1].initial if k else None)
    return plan


_ADDED = "part int, pos long, n long, edit string, before string, into string, cost long, blank long, duplicate long, truncated long, illegal long"


def edits(rows: DataFrame) -> DataFrame:
    """What is to be done with each distinct turn, in the order of (part, pos) within its conversation.

    TURN, n (equal rows; all but the first are deleted), ``edit`` (its macro code), ``before``
    (roles inserted in front, comma-joined), ``into`` (its role after, null if deleted), and the turn's
    share in cost and faults.  Inserts that end a conversation are a row without a turn.
    """
    turns = skeleton(rows)
    plan = turns.sparkSession.sparkContext.broadcast(_plan(turns))
    kind = dict(turns.dtypes)
    said = [[",".join(ROLE[c] for c in _after(p, len(code) - 1)[0]) or None for code in CODES] for p in range(4)]

    def reconstruct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for table, is_first, is_last in _closed(batches):
            kinds, n = _numbers(table, "kind", "n")
            starts = _runs(table.column("conv_id"))
            low, size = starts[:-1], np.diff(starts)
            entry, goal, final = np.zeros(len(size), np.int64), np.full(len(size), -1), np.ones(len(size), bool)
            previous = np.full(len(size), -1)
            for run, known in ((0, is_first), (len(size) - 1, is_last)):
                found = plan.value.get((part, bool(run == 0 and is_first))) if known else None
                if found:
                    entry[run], goal[run], final[run] = found[:3]
                    previous[run] = -1 if found[3] is None else found[3]
            order = np.argsort(-size, kind="stable")
            every = (START,) if (entry == START).all() else (START, S, U, A)
            cost, rank, parents = layers(kinds, low[order], size[order], every)
            own = entry[order]
            best = ending(cost[np.arange(len(order)), own], rank[np.arange(len(order)), own])
            state = np.where(goal[order] < 0, best, goal[order])
            before, codes = (np.empty(len(kinds), np.int64) for _ in range(2))
            b, c = back(parents, size[order], own, state)
            to = np.repeat(low[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(kinds))
            before[to], codes[to] = b, c

            initial, fault = kinds % 4, kinds // 4
            earlier = np.concatenate([[0], initial[:-1]])
            earlier[low] = previous
            wrong = np.where(earlier < 0, False, ~_LEGAL[earlier, initial]) + (n - 1)
            letters = [CODES[k] for k in codes.tolist()]
            roles = table.column("role").to_pylist()
            into = [None if e[-1] == "D" else r if e[-1] == "K" else ROLE[NEXT[_after(p, len(e) - 1)[1]][0]] for e, r, p in zip(letters, roles, before.tolist())]
            runs = np.array([len(e) - 1 for e in letters])
            last = np.array([e[-1] for e in letters])
            paid = INSERT * runs + np.where(last == "D", DELETE, np.where(last == "R", REROLE, KEEP) + UNFINISHED * (fault == TRUNCATED)) + DELETE * (n - 1)
            again = np.where(fault == BLANK, 0, np.where(fault == DUPLICATE, n, n - 1))
            added = [
                np.full(len(kinds), part, np.int32), pos + np.arange(len(kinds)), n, letters, [said[p][k] for p, k in zip(before.tolist(), codes.tolist())], into,
                paid, np.where(fault == BLANK, n, 0), again, (fault == TRUNCATED).astype(np.int64), wrong,
            ]
            pos += len(kinds)
            # Inserts behind the last turn: rows without a turn.
            tail = [r for r in range(len(order)) if final[order[r]] and ENDING[int(state[r])]]
            ids, more = table.column("conv_id"), []
            for r in tail:
                s = int(state[r])
                roles_in = ",".join(ROLE[x] for x in _after(s, ENDING[s])[0])
                more.append((int(low[order[r]]), "I" * ENDING[s], roles_in, INSERT * ENDING[s]))
            names = [f.split()[0] for f in _ADDED.split(", ")]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5]
            body = [table.column(c).combine_chunks() for c in TURN] + [pa.array(v, t) for v, t in zip(added, types)]
            yield pa.RecordBatch.from_arrays(body, [*TURN, *names])
            if more:
                count = len(more)
                nothing = [pa.nulls(count, table.schema.field(c).type) for c in TURN[1:]]
                values = [[part] * count, [pos + k for k in range(count)], [1] * count, [m[1] for m in more], [m[2] for m in more], [None] * count, [m[3] for m in more], *[[0] * count] * 4]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([m[0] for m in more])).combine_chunks(), *nothing, *[pa.array(v, t) for v, t in zip(values, types)]], [*TURN, *names])
                pos += count

    # Written at once: a task's number is that of its partition in this plan alone.
    return cut(turns.mapInArrow(reconstruct, ", ".join(f"{c} {kind[c]}" for c in TURN) + ", " + _ADDED))


def repaired(done: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, part, pos, sub (their order), role, text."""
    texts = _filled(rows).groupBy(*TURN).agg(F.any_value("text").alias("text"))
    kept = done.where("into is not null")
    own = _joined(kept, texts, TURN, "inner").select("conv_id", "part", "pos", F.lit(1000).alias("sub"), F.col("into").alias("role"), "text")
    new = done.where("before is not null").select("conv_id", "part", "pos", F.posexplode(F.split("before", ",")).alias("sub", "role"), F.lit("").alias("text"))
    return own.unionByName(new)


def digest(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation in ``ids``: faults of ``rows``, cost, audit and hash of its repair.

    The audit and the hash are one value a conversation and so are made in one place.
    """
    done = edits(rows)
    in_turn = lambda items, value: F.transform(F.array_sort(items), value)
    letters = F.concat(F.col("edit"), F.repeat(F.lit("D"), (F.col("n") - 1).cast("int")))
    totals = done.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(in_turn(F.collect_list(F.struct("part", "pos", letters.alias("e"))), lambda x: x["e"]), "").alias("audit"),
    )
    lines = F.struct("part", "pos", "sub", F.concat_ws(":", "role", "text").alias("line"))
    whole = repaired(done, rows).groupBy("conv_id").agg(F.sha2(F.array_join(in_turn(F.collect_list(lines), lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = ids.select("conv_id").distinct()
    for more in (gaps, totals, whole):
        out = _joined(out, more, ("conv_id",), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
