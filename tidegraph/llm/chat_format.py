"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal chats are an optional system turn, then user and assistant in turn, beginning with the user. Each given turn is
kept, relabelled, merged into the turn before it, or preceded by an inserted empty turn; the cheapest way is found by
dynamic programming. Costs of a stretch of turns form a (min, +) matrix over the states, and such matrices multiply,
so a conversation may lie in several partitions: their outer stretches are multiplied first, then every partition
repairs its own turns with the costs that enter and leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.workspace import checkpointed

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
NEXT = {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40


def _moves() -> list[list[list[tuple[int, str, tuple[int, ...]]]]]:
    """For each role (0: any other), state before and state after: (cost, action, inserted roles) of the cheapest way.

    Ties go to the first of keep, merge, relabel, insert.
    """
    out = []
    for role in range(4):
        table = [[(FAR, "", ()) for _ in range(4)] for _ in range(4)]
        for before in range(4):
            ways = []
            for after in NEXT[before]:
                ways.append((after, 0 if after == role else RELABEL, "keep" if after == role else "relabel", ()))
                for last in NEXT[after]:
                    ways.append((last, INSERT + (0 if last == role else RELABEL), "keep" if last == role else "relabel", (after,)))
                    for end in NEXT[last]:
                        ways.append((end, 2 * INSERT + (0 if end == role else RELABEL), "keep" if end == role else "relabel", (after, last)))
            if before != START:
                ways.append((before, MERGE + (0 if before == role else RELABEL), "merge" if before == role else "relabel and merge", ()))
            for after, cost, action, inserted in sorted(ways, key=lambda w: (w[1], len(w[3]), w[2] != "merge")):
                if cost < table[before][after][0]:
                    table[before][after] = (cost, action, inserted)
        out.append(table)
    return out


MOVES = _moves()
Costs = tuple[int, ...]
#: What a turn does to costs of the states that are 0 at least: the costs after it less their least, that least, and
#: the best state before each state after. Only few such costs ever occur, so each is worked out once.
_STEPS: dict[tuple[Costs, int], tuple[Costs, int, Costs]] = {}


def _step(costs: Costs, role: int) -> tuple[Costs, int, Costs]:
    found = _STEPS.get((costs, role))
    if found is None:
        ways = [[costs[p] + MOVES[role][p][q][0] for p in range(4)] for q in range(4)]
        least = [min(w) for w in ways]
        low = min(least)
        found = _STEPS[costs, role] = (tuple([FAR if x >= FAR else x - low for x in least]), min(low, FAR), tuple([w.index(x) for w, x in zip(ways, least, strict=True)]))
    return found


def _levelled(costs: Sequence[int]) -> tuple[Costs, int]:
    low = min(costs)
    return tuple([FAR if x >= FAR else x - low for x in costs]), low


def multiply(a: Sequence[int], b: Sequence[Sequence[int]]) -> Costs:
    """The (min, +) product of a row of costs and a matrix."""
    return tuple([min(FAR, *[a[p] + b[p][q] for p in range(4)]) for q in range(4)])


def stretch_costs(roles: Sequence[int]) -> list[Costs]:
    """Cheapest cost from every state before a stretch of turns to every state after it."""
    out = []
    for begin in range(4):
        costs, base = tuple([0 if p == begin else FAR for p in range(4)]), 0
        for r in roles:
            costs, more, _ = _step(costs, r)
            base += more
        out.append(tuple([FAR if x >= FAR else min(FAR, x + base) for x in costs]))
    return out


def repair(roles: Sequence[int], enter: Sequence[int], leave: Sequence[int]) -> tuple[list[tuple[int, str, tuple[int, ...]]], int, int]:
    """The cheapest path: (new role, action, inserted roles) of each turn, its cost in all, and the state before it.

    ``enter``: costs of the states before the stretch; ``leave``: costs from the states after it to a legal end.
    """
    costs, base = _levelled(enter)
    back = []
    for r in roles:
        costs, more, best = _step(costs, r)
        base += more
        back.append(best)
    ends = [x + y for x, y in zip(costs, leave, strict=True)]
    state = ends.index(min(ends))
    total = base + ends[state]
    out = []
    for r, best in zip(reversed(roles), reversed(back), strict=True):
        before = best[state]
        _, action, inserted = MOVES[r][before][state]
        out.append((state, action, inserted))
        state = before
    return out[::-1], total, state


def role_code(role: str | None) -> int:
    return ROLES.get(role.strip().lower(), 0) if isinstance(role, str) else 0


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition, sorted by conversation, one conversation's rows at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["conv_id"].astype("Int64").fillna(-(1 << 62)).to_numpy()
        alone = -(1 << 62)
        cuts = [0, *[k for k in range(1, len(key)) if key[k] != key[k - 1] or key[k] == alone], len(batch)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = batch.iloc[lo:hi]
            if held and not _same(held[0], part):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    """Rows without conv_id are each a conversation of their own."""
    x, y = a["conv_id"].iloc[0], b["conv_id"].iloc[0]
    return not pd.isna(x) and not pd.isna(y) and x == y


END = "<|end|>\n"


def escaped(text: str) -> str:
    """A text that can't be read as a mark: ``<|`` gets a backslash between, and one more where backslashes stand there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def parsed(chat: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered chat; what ``format_chats`` renders reads back as it was."""
    turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", chat, re.S)
    return [(role, unescaped(text)) for role, text in turns]


def render(role: int, text: str, merged: bool) -> str:
    """What a turn adds to the rendered chat; its end mark comes with the next turn that isn't merged, or at the end."""
    return f"\n{escaped(text)}" if merged else f"<|{NAMES[role]}|>\n{escaped(text)}"


def format_chats(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per given turn: ``conv_id, turn, role, position, new_role, action, inserted, conv_cost, rendered``.

    The rendered pieces of a conversation, in the order of ``position``, join to the repaired chat (``whole_chats``); a
    piece holds the inserted empty turns before it, the last one the last end mark. Marks inside texts are escaped,
    and ``parsed`` reads the chat back. Turns stand in the order of turn, role and text, nulls first; alike rows are
    alike. An unknown or null role must be relabelled or merged. A null text counts as empty; long texts are taken
    whole. A row without conv_id is a conversation of its own. A chat may end after any turn. ``conv_cost`` is the cost of the
    whole conversation. Other columns are not read, so their names clash with nothing.
    """
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "__tie"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    rows = checkpointed(rows)  # both passes must see the same rows in the same partitions

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: list[tuple] = []
        for k, rows in enumerate(_stretches(batches)):
            conv = rows["conv_id"].iloc[0]
            found = [*found[:1], (part, k, None if pd.isna(conv) else int(conv), rows["role"].tolist())]
        yield pd.DataFrame([(p, k, c, sum(stretch_costs([role_code(r) for r in roles]), ())) for p, k, c, roles in found], columns=["part", "k", "conv_id", "costs"]).astype({"conv_id": "Int64"})

    # the first and the last stretch of each partition: two rows at most
    edges = [(r.part, r.k, r.conv_id, [tuple(r.costs[k : k + 4]) for k in (0, 4, 8, 12)]) for r in sorted(rows.mapInPandas(outer, "part int, k int, conv_id long, costs array<long>").collect(), key=lambda r: (r.part, r.k))]
    joined = lambda k: 0 < k < len(edges) and edges[k][2] is not None and edges[k - 1][2] == edges[k][2]
    begin, free = (0, FAR, FAR, FAR), (0, 0, 0, 0)
    enter: dict[tuple[int, int], Costs] = {}
    leave: dict[tuple[int, int], Costs] = {}
    begun, goes_on = set(), set()  # stretches that an earlier partition began, or a later one goes on with
    for k, (part, at, _, _) in enumerate(edges):
        enter[part, at] = multiply(enter[edges[k - 1][:2]], edges[k - 1][3]) if joined(k) else begin
        if joined(k):
            begun.add((part, at))
    for k in range(len(edges) - 1, -1, -1):
        after = edges[k + 1] if joined(k + 1) else None
        leave[edges[k][:2]] = tuple([min(x + y for x, y in zip(row, leave[after[:2]], strict=True)) for row in after[3]]) if after else free
        if after:
            goes_on.add(edges[k][:2])

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for k, rows in enumerate(_stretches(batches)):
            path, total, _ = repair([role_code(r) for r in rows["role"]], enter.get((part, k), begin), leave.get((part, k), free))
            pieces = []
            for i, ((role, action, inserted), text) in enumerate(zip(path, rows["text"], strict=True)):
                merged = action.endswith("merge")
                piece = "".join([render(x, "", False) + END for x in inserted]) + render(role, text if isinstance(text, str) else "", merged)
                pieces.append(piece if merged or (i == 0 and (part, k) not in begun) else END + piece)
            if (part, k) not in goes_on:
                pieces[-1] += END
            yield pd.DataFrame({"conv_id": rows["conv_id"].astype("Int64"), "turn": rows["turn"].astype("Int64"), "role": rows["role"], "position": [(part << 40) + at + i for i in range(len(rows))], "new_role": [NAMES[p[0]] for p in path], "action": [p[1] for p in path], "inserted": [",".join([NAMES[x] for x in p[2]]) for p in path], "conv_cost": total, "rendered": pieces})
            at += len(rows)

    return rows.mapInPandas(mend, "conv_id long, turn long, role string, position long, new_role string, action string, inserted string, conv_cost long, rendered string")


def whole_chats(pieces: DataFrame, most_chars: int = 1 << 24) -> DataFrame:
    """One row per conversation of ``format_chats``: ``conv_id, n_turns, conv_cost, n_chars, chat``.

    A conversation of more than ``most_chars`` characters doesn't fit a row: its ``chat`` is null, its pieces are
    where they were. Rows without conv_id are a conversation each.
    """
    key = F.struct("conv_id", F.when(F.col("conv_id").isNull(), F.col("position")).alias("alone"))
    keyed = pieces.withColumn("key", key)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n_turns"), F.max("conv_cost").alias("conv_cost"), F.sum(F.char_length("rendered")).alias("n_chars"))
    small = sizes.where(F.col("n_chars") <= most_chars).select("key")
    chats = keyed.join(small, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("all"))
    chats = chats.select("key", F.array_join("all.rendered", "").alias("chat"))
    return sizes.join(chats, "key", "left").select("key.conv_id", "n_turns", "conv_cost", "n_chars", "chat")
