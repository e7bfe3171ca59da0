"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is: an optional system turn, then user and assistant in turn, ending with assistant.
Every input turn is kept; a repair may merge it into the turn before (same role), relabel it, or put empty turns
before it. The cheapest repair is a shortest path over the automaton's states.

Shortest paths compose: a block of turns is a 4 x 4 matrix of least costs between states. Rows are sorted globally by
(conversation, turn), numbered within their conversation and cut into blocks of 1,024 turns by that number, so a
conversation of any length is many small tasks and its blocks do not depend on how the rows are spread. Blocks are
summed up in parallel, and so are blocks of 1,024 blocks, level by level; the states at the boundaries are found from
the top down, and then every block is decoded by itself. Conversations of one block need no boundary step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.common import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 2, 3, 4
BLOCK_BITS = 10
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BIG = 1 << 40
#: Empty turns that must come between a state and a role: roles to put in, or None if no number of them helps.
_BETWEEN: dict[tuple[int, int], tuple[int, ...] | None] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, SYSTEM): None, (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation.
_ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _step(role: int) -> np.ndarray:
    """cost[s, t] of taking a turn of input role ``role`` (0 if unknown) from state s to state t."""
    cost = np.full((4, 4), BIG, dtype=np.int64)
    for (s, t), between in _BETWEEN.items():
        if between is not None:
            cost[s, t] = INSERT * len(between)
    for t in (SYSTEM, USER, ASSISTANT):
        cost[t, t] = min(cost[t, t], MERGE)
        cost[:, t] += RELABEL * (role != t)
    return np.minimum(cost, BIG)


STEPS = [_step(r) for r in range(4)]
END = np.array([INSERT * len(_ENDING[s]) for s in range(4)], dtype=np.int64)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def block_matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state before the block to each state after it."""
    total = np.where(np.eye(4, dtype=bool), 0, BIG)
    for r in roles:
        total = np.minimum((total[:, :, None] + STEPS[r][None, :, :]).min(axis=1), BIG)
    return total


def best_path(roles: list[int], enter: int = START, leave: int | None = None) -> list[int]:
    """The state after each turn on a cheapest path; without ``leave``, the conversation ends after the block.

    Among equal costs the smallest state counts, from the last turn backwards.
    """
    costs = [[0 if s == enter else BIG for s in range(4)]]
    back = []
    for r in roles:
        step, last = _STEP_LISTS[r], costs[-1]
        now, came = [BIG] * 4, [0] * 4
        for t in (1, 2, 3):
            for s in range(4):
                c = last[s] + step[s][t]
                if c < now[t]:
                    now[t], came[t] = c, s
        costs.append(now)
        back.append(came)
    state = min(range(4), key=lambda s: costs[-1][s] + int(END[s])) if leave is None else leave
    path = []
    for came in reversed(back):
        path.append(state)
        state = came[state]
    return path[::-1]


_STEP_LISTS = [x.tolist() for x in STEPS]


def boundaries(matrices: list[np.ndarray], enter: int = START, leave: int | None = None) -> list[tuple[int, int | None]]:
    """(state before, state after) of every block of a row of blocks; without ``leave`` the conversation ends behind it.

    Among equal costs the smallest state counts, from the last boundary backwards; the last one's after is ``leave``.
    """
    costs = [np.where(np.arange(4) == enter, 0, BIG).astype(np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), BIG))
    state, found = int(np.argmin(costs[-1] + END)) if leave is None else leave, []
    for i in range(len(matrices) - 1, -1, -1):
        before = int(np.argmin(costs[i] + matrices[i][:, state]))
        found.append((before, state if i < len(matrices) - 1 else leave))
        state = before
    return found[::-1]


def composed(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of a row of blocks."""
    total = matrices[0]
    for m in matrices[1:]:
        total = np.minimum((total[:, :, None] + m[None, :, :]).min(axis=1), BIG)
    return total


def _turn(role: int, text: str = "") -> str:
    return f"{OPEN}{ROLES[role - 1]}\n{text}"


def render(roles: list[int], texts: list[str | None], path: list[int], enter: int, last: bool) -> list[tuple[str, str]]:
    """(action, piece) of every turn; the pieces of a conversation in order make up its rendered text."""
    out, state = [], enter
    for i, (role, text, now) in enumerate(zip(roles, texts, path, strict=True)):
        safe = (text or "").replace(OPEN, "<| im_start |>").replace(CLOSE, "<| im_end |>")
        between = _BETWEEN[state, now]
        merged = state == now and (between is None or MERGE <= INSERT * len(between))
        close = "" if state == START else f"{CLOSE}\n"
        actions = ["relabel"] if role != now else []
        if merged:
            piece = "\n" + safe
            actions.append("merge")
        else:
            piece = close + "".join(f"{_turn(x)}{CLOSE}\n" for x in between) + _turn(now, safe)
            actions += ["insert"] * len(between)
        if last and i == len(path) - 1:
            piece += f"{CLOSE}\n" + "".join(f"{_turn(x)}{CLOSE}\n" for x in _ENDING[now])
            actions += ["append"] * len(_ENDING[now])
        out.append((",".join(actions) or "keep", piece))
        state = now
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a sorted partition, cut so that a block is never split."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (rows["conv"] == rows["conv"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
        rest = rows[last]
        if not last.all():
            yield rows[~last]
    if rest is not None and len(rest):
        yield rest


def _blocks(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
    conv, block = rows["conv"].to_numpy(), rows["block"].to_numpy()
    starts = np.concatenate(([0], np.flatnonzero((conv[1:] != conv[:-1]) | (block[1:] != block[:-1])) + 1, [len(rows)]))
    return zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _runs(batches):
        roles, conv, block = rows["role"].map(role_number).tolist(), rows["conv"].tolist(), rows["block"].tolist()
        yield pd.DataFrame([(conv[a], block[a], block_matrix(roles[a:b]).ravel().tolist()) for a, b in _blocks(rows)], columns=["conv", "block", "matrix"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``, a row's number among those of its conversation in its sorted partition."""
    last, count = None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
        at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            first = int(starts[1]) if len(starts) > 1 else len(conv)
            at[:first] += count
        last, count = conv[-1], int(at[-1]) + 1
        yield batch.append_column("at", pa.array(at, type=pa.int64()))


def _matrices(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, dtype=np.int64).reshape(4, 4) for m in rows["matrix"]]


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block")
    return pd.DataFrame({"conv": rows["conv"].iloc[:1], "block": rows["over"].iloc[:1], "matrix": [composed(_matrices(rows)).ravel().tolist()]})


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block")
    leave = int(rows["leave"].iloc[0])
    ends = boundaries(_matrices(rows), int(rows["enter"].iloc[0]), None if leave < 0 else leave)
    return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "enter": [e for e, _ in ends], "leave": [-1 if x is None else x for _, x in ends]})


def block_ends(summaries: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv, block, enter, leave) of the blocks (conv, block, matrix) of conversations of more than one block.

    2^bits blocks at a time make up a block of the level above, until each conversation is one; no task holds more.
    """
    over = F.shiftright("block", bits).alias("over")
    levels = [summaries.join(summaries.where("block > 0").select("conv").distinct(), "conv", "left_semi").select("*", over)]
    while not levels[-1].where("over > 0").isEmpty():
        up = levels[-1].groupBy("conv", "over").applyInPandas(_compose, "conv string, block long, matrix array<long>")
        levels.append(stored(up.select("*", over), "conversation-levels"))
    ends = None
    for level in reversed(levels):
        if ends is None:
            rows = level.select("*", F.lit(START).alias("enter"), F.lit(-1).alias("leave"))
        else:
            rows = level.join(ends.withColumnRenamed("block", "over"), ["conv", "over"])
        ends = rows.select("conv", "over", "block", "matrix", "enter", "leave").groupBy("conv", "over").applyInPandas(_scan, "conv string, block long, enter int, leave int")
    return ends


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _runs(batches):
        roles, texts, enters, leaves = rows["role"].map(role_number).tolist(), rows["text"].tolist(), rows["enter"].tolist(), rows["leave"].tolist()
        new, actions, pieces = [], [], []
        for a, b in _blocks(rows):
            path = best_path(roles[a:b], enters[a], None if leaves[a] < 0 else leaves[a])
            for state, (action, piece) in zip(path, render(roles[a:b], texts[a:b], path, enters[a], leaves[a] < 0), strict=True):
                new.append(ROLES[state - 1])
                actions.append(action)
                pieces.append(piece)
        yield pd.DataFrame({"conv": rows["conv"], "turn": rows["turn"], "position": rows["position"], "role": rows["role"], "new_role": new, "action": actions, "rendered": pieces})


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, position, role, new_role, action, rendered) for every turn of (conv_id, turn, role, text).

    ``position`` counts the turns of a conversation from 0. The concatenation of ``rendered`` by ``position`` is the conversation in chat markup. Defined cases: turns without
    number come first; equal turn numbers are ordered by role and text, and every repeated row stays a turn; roles are
    read without case and outer blanks, and an unknown or null one is relabelled; a null text is an empty one; markup
    inside a text is broken up by blanks; a null conv_id is one conversation of its own; extra columns are not read;
    an empty table gives no rows. Among repairs of equal cost the smallest state counts (system, user, assistant),
    from the end backwards, over the blocks of 1,024 turns first and then within each; so the same rows get the same
    repair however they are spread.
    """
    order = ["conv", "turn", "role", "tie"]
    rows = conversations.select(
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("null")).alias("conv"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.select(F.col("turn").cast("string").alias("turn"), "role", "text", "conv", F.spark_partition_id().alias("part"))
    columns = "turn string, role string, text string, conv string, part int"
    ordered = stored(spread.mapInArrow(_numbered, f"{columns}, at long"), "conversation-turns")
    # a conversation that goes on in a partition is the first one there, so shifts has at most a row for each partition
    slices = ordered.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = slices.select("conv", "part", before.alias("before")).where("before > 0")
    ordered = ordered.join(F.broadcast(shifts), ["conv", "part"], "left").withColumn("position", F.col("at") + F.coalesce("before", F.lit(0)))
    ordered = ordered.select("turn", "role", "text", "conv", "position", F.shiftright("position", BLOCK_BITS).alias("block"))
    sort = ["conv", "block", "position"]
    summaries = stored(
        ordered.select("conv", "block", "position", "role").repartition("conv", "block").sortWithinPartitions(*sort).mapInPandas(_summaries, "conv string, block long, matrix array<long>"), "conversation-blocks"
    )
    ends = block_ends(summaries)
    placed = ordered.repartition("conv", "block").join(ends, ["conv", "block"], "left").fillna({"enter": START, "leave": -1})
    out = placed.sortWithinPartitions(*sort).mapInPandas(_decode, "conv string, turn string, position long, role string, new_role string, action string, rendered string")
    return out.select(F.col("conv").try_cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "position", "role", "new_role", "action", "rendered")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its roles repaired at least cost; cases as in ``formatted``."""
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
