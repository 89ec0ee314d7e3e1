"""Chat formatting with minimum-cost role repair over an automaton of legal turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned
from larder.llm.batches import tidy

# States of the automaton: what the last rendered turn is. A conversation is an optional system turn,
# then user and assistant in turn; it ends with the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
STATE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
MERGE, RELABEL, INSERT = 1, 2, 3  # costs: text joins the turn before, role is changed, an empty turn is added
TIE = 1 << 20  # ties between repairs of equal cost go by a digest of the turn, so they never depend on partitions
OPENED, CLOSED = "<|im_start|>", "<|im_end|>"  # fixed values of the format
# Empty turns that make a role legal after a state; a pair that is missing can't be made legal.
BETWEEN = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, USER): [ASSISTANT],
    (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
AT_END = {START: [USER, ASSISTANT], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
FAR = 1 << 200


def _moves(role: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, action) for a turn whose own role is ``role`` (0: unknown)."""
    out = []
    for (before, after), empty in BETWEEN.items():
        changed = after != role
        out.append((before, after, INSERT * len(empty) + RELABEL * changed, "relabel" if changed else "keep"))
    for state in (SYSTEM, USER, ASSISTANT):
        out.append((state, state, MERGE + RELABEL * (state != role), "merge"))
    return out


MOVES = [_moves(role) for role in range(4)]


def _steps(role: int, mark: int) -> list[tuple[int, int, int, str]]:
    """Moves with costs that hold no ties: the digest of the turn decides below the units."""
    return [(p, q, (cost << 64) + xxhash.xxh64_intdigest(bytes([p, q, action == "merge"]), mark) % TIE, action) for p, q, cost, action in MOVES[role]]


def _forward(costs: list[int], role: int, mark: int) -> tuple[list[int], list[tuple]]:
    after, back = [FAR] * 4, [None] * 4
    for p, q, cost, action in _steps(role, mark):
        if costs[p] + cost < after[q]:
            after[q], back[q] = costs[p] + cost, (p, action)
    return after, back


def transfer(turns: list[tuple[int, int]]) -> list[list[int]]:
    """Least cost of a block of turns from every state to every state."""
    rows = []
    for start in range(4):
        costs = [0 if s == start else FAR for s in range(4)]
        for role, mark in turns:
            costs, _ = _forward(costs, role, mark)
        rows.append(costs)
    return rows


def path(turns: list[tuple[int, int]], entry: int, leave: int | None) -> tuple[list[tuple[int, int, str]], int]:
    """(state before, state after, action) of each turn on the cheapest way from ``entry`` to
    ``leave`` (None: the best end), and its cost with the empty turns after the end."""
    costs, backs = [0 if s == entry else FAR for s in range(4)], []
    for role, mark in turns:
        costs, back = _forward(costs, role, mark)
        backs.append(back)
    if leave is None:
        costs = [c + (INSERT * len(AT_END[s]) << 64) for s, c in enumerate(costs)]
        leave = min(range(4), key=costs.__getitem__)
    total, state, out = costs[leave], leave, []
    for back in reversed(backs):
        before, action = back[state]
        out.append((before, state, action))
        state = before
    return out[::-1], total


def _empty(states: list[int]) -> str:
    return "".join(f"{OPENED}{NAMES[s]}\n{CLOSED}\n" for s in states)


def repaired(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every source turn: ``conv_id``, ``turn``, ``position`` (from 0), ``role`` after the
    repair, ``action`` (keep, relabel or merge), ``inserted`` (empty turns put before it, comma-joined;
    after the last turn they follow a ``|``), ``rendered`` and ``units``, the cost of the turn.

    Joined by position, the rendered parts of a conversation are its text. The repairs are those of
    least total cost: a merge joins a turn's text to the turn before, a relabel changes its role, an
    insertion adds an empty turn. Roles are compared in lower case without blanks around; null and
    other roles are unknown and have to be relabelled or merged. Null texts render as empty. Turns
    are ordered by number, null first; equal numbers by role and text, rows repeated in full are
    turns of their own. Null ids form one conversation. The markers of the format inside a text are
    broken up by a blank, so that a text can't forge a turn. An empty table gives no rows.

    Rows are dealt by range, so a conversation of any length lies in many partitions in order. Each
    partition gives the transfer costs of its first and last conversation, which are all that can
    continue elsewhere; these few rows fix the states at the limits, and every partition then
    finds its own part of the path.
    """
    own = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.lower(F.trim(role)).alias("said"), F.col(text).alias("text"))
    own = own.withColumn("mark", F.xxhash64("conv_id", "turn", "said", "text")).withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "said", "mark", "tie"]
    dealt = pinned(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    dealt = pinned(dealt.withColumn("seq", F.monotonically_increasing_id()).drop("tie"))
    narrow = dealt.select("part", "seq", F.struct("conv_id").alias("c"), "said", "mark")
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[list] = []  # the first and the last conversation of the partition
        for batch in batches:
            for part, c, said, mark in zip(*(batch.column(n).to_pylist() for n in ("part", "c", "said", "mark"))):
                if not blocks or blocks[-1][:2] != [part, c["conv_id"]]:
                    if len(blocks) > 1:
                        blocks.pop()
                    blocks.append([part, c["conv_id"], 0, [[0 if s == t else FAR for s in range(4)] for t in range(4)]])
                block, step = blocks[-1], STATE.get(said, START)
                block[2] += 1
                block[3] = [_forward(costs, step, mark)[0] for costs in block[3]]
        if blocks:
            flat = [[str(x) for row in b[3] for x in row] for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in blocks], pa.int32()), pa.array([{"conv_id": b[1]} for b in blocks], batch.column("c").type),
                 pa.array([b[2] for b in blocks], pa.int64()), pa.array(flat, pa.list_(pa.string()))], ["part", "c", "n", "costs"])

    ends = narrow.mapInArrow(tidy(limits), f"part int, c struct<conv_id:{kind}>, n long, costs array<string>").collect()  # two rows a partition
    known = joints([(r["part"], r["c"]["conv_id"], r["n"], [int(x) for x in r["costs"]]) for r in ends])
    shared = dealt.sparkSession.sparkContext.broadcast(known)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _conversations(batches):
            part, conv = rows[0]["part"], rows[0]["conv_id"]
            entry, leave, offset = shared.value.get((part, conv), (START, None, 0))
            steps, _ = path([(STATE.get(r["said"], START), r["mark"]) for r in rows], entry, leave)
            out: dict[str, list] = {n: [] for n in ("conv_id", "turn", "position", "role", "action", "inserted", "rendered", "units")}
            for i, (row, (before, after, action)) in enumerate(zip(rows, steps)):
                body = (row["text"] or "").replace("<|im_", "<| im_")
                merged = action == "merge"
                empty = [] if merged else BETWEEN[before, after]
                lead = "\n" if merged else (f"{CLOSED}\n" if before != START else "") + _empty(empty) + f"{OPENED}{NAMES[after]}\n"
                changed = after != STATE.get(row["said"], START)
                tail, inserted = "", ",".join(NAMES[s] for s in empty)
                if leave is None and i == len(rows) - 1:
                    tail = f"{CLOSED}\n" + _empty(AT_END[after])
                    inserted += "|" + ",".join(NAMES[s] for s in AT_END[after]) if AT_END[after] else ""
                    empty = empty + AT_END[after]
                values = (conv, row["turn"], offset + i, NAMES[after], action, inserted, lead + body + tail, MERGE * merged + RELABEL * changed + INSERT * len(empty))
                for name, value in zip(out, values):
                    out[name].append(value)
            types = [conv_type, turn_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type, turn_type = (to_arrow_type(dealt.schema[n].dataType) for n in ("conv_id", "turn"))
    shape = f"conv_id {kind}, turn {dealt.schema['turn'].dataType.simpleString()}, position long, role string, action string, inserted string, rendered string, units long"
    return dealt.mapInArrow(tidy(render), shape)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Turns of one conversation in one partition, in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["part"], held[0]["conv_id"]) != (row["part"], row["conv_id"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def joints(blocks: list[tuple[int, object, int, list[int]]]) -> dict:
    """State at entry, state at the end (None where the conversation ends) and turns before, by
    (partition, conversation). Blocks are (partition, conversation, turns, 4 x 4 costs)."""
    chains: dict[object, list] = {}
    for block in sorted(blocks, key=lambda b: b[0]):
        chains.setdefault(block[1], []).append(block)
    out = {}
    for conv, chain in chains.items():
        costs, befores = [0, FAR, FAR, FAR], []
        for _, _, _, flat in chain:
            befores.append(costs)
            costs = [min(costs[p] + flat[4 * p + q] for p in range(4)) for q in range(4)]
        final = [c + (INSERT * len(AT_END[s]) << 64) for s, c in enumerate(costs)]
        leave, states = min(range(4), key=final.__getitem__), []
        for before, (_, _, _, flat) in zip(reversed(befores), reversed(chain)):
            states.append((min(range(4), key=lambda p: before[p] + flat[4 * p + leave]), leave))  # noqa: B023
            leave = states[-1][0]
        offset = 0
        for i, ((part, _, n, _), (entry, leave)) in enumerate(zip(chain, reversed(states))):
            out[part, conv] = (entry, None if i == len(chain) - 1 else leave, offset)
            offset += n
    return out
