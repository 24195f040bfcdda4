"""Chat formatting by minimum-cost role repair.

Legal: at most one system turn, first; then user and assistant in turn, user first, assistant last. A dynamic program
over the automaton of these turns (states: start, after system, after user, after assistant) picks for each turn a
role and how it joins on: in order (free), merged into a turn of the same role, or after an empty turn of the missing
role. Costs: MERGE, INSERT for an empty turn, RELABEL for another role, UNKNOWN for giving a role to a turn without a known one.
The cheapest repair is rendered, one row per turn; the pieces of a conversation in order of `pos` are its text. In texts `<|` is
escaped, so parse() gives back the repaired turns and no text can pass for a turn.

A conversation may hold any share of the rows. Turns are dealt by range of (conv_id, turn) and cut into chunks of at
most CHUNK_TURNS. For a conversation that crosses chunks, each chunk gives the least cost from every state to every
state, a 4 x 4 min-plus matrix; their products along the conversation fix the states at the cuts, and then every
chunk is repaired by itself. Per chunk one small row meets in the task of its conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import materialize, shuffle_partitions

CHUNK_TURNS = 512
CHUNK_BYTES = 1 << 20
MERGE, INSERT, RELABEL, UNKNOWN = 1, 3, 2, 1
FAR = 1 << 40

ROLES = ("system", "user", "assistant")
# Other names of the roles.
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2}
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role) -> (cost, merged, roles of empty turns before)
MOVES = {
    (START, 0): (0, False, ()),
    (START, 1): (0, False, ()),
    (START, 2): (INSERT, False, (1,)),
    (SYSTEM, 0): (MERGE, True, ()),
    (SYSTEM, 1): (0, False, ()),
    (SYSTEM, 2): (INSERT, False, (1,)),
    (USER, 1): (MERGE, True, ()),
    (USER, 2): (0, False, ()),
    (ASSISTANT, 2): (MERGE, True, ()),
    (ASSISTANT, 1): (0, False, ()),
}
#: state -> (cost, roles of empty turns at the end)
ENDS = {START: (0, ()), SYSTEM: (2 * INSERT, (1, 2)), USER: (INSERT, (2,)), ASSISTANT: (0, ())}


def role_of(role: str | None) -> int | None:
    return ALIASES.get((role or "").strip().lower())


def label_cost(given: int | None, role: int) -> int:
    if given is None:
        return UNKNOWN + (role == 0)
    return 0 if given == role else RELABEL


def _step(costs: list[int], given: int | None) -> tuple[list[int], list[int]]:
    """Least cost of each state after one more turn, and the state before it."""
    new, back = [FAR] * 4, [-1] * 4
    for (state, role), (cost, _, _) in MOVES.items():
        total = costs[state] + cost + label_cost(given, role)
        if total < new[role + 1] and costs[state] < FAR:
            new[role + 1], back[role + 1] = total, state
    return new, back


def matrix(roles: list[int | None]) -> list[int]:
    """Least cost from every state to every state over these turns, row by row."""
    out: list[int] = []
    for start in range(4):
        costs = [FAR] * 4
        costs[start] = 0
        for given in roles:
            costs, _ = _step(costs, given)
        out += costs
    return out


def repair(roles: list[int | None], start: int = START, end: int | None = None) -> list[tuple[int, bool, tuple]]:
    """(role, merged, empty turns before) of each turn on the cheapest way from start to end (None: any legal end)."""
    costs = [FAR] * 4
    costs[start] = 0
    backs = []
    for given in roles:
        costs, back = _step(costs, given)
        backs.append(back)
    state = min(range(4), key=lambda s: (costs[s] + ENDS[s][0], s)) if end is None else end
    path = []
    for back in reversed(backs):
        before = back[state]
        _, merged, empty = MOVES[(before, state - 1)]
        path.append((state - 1, merged, empty))
        state = before
    return path[::-1]


def total_cost(roles: list[int | None]) -> int:
    costs = [0, FAR, FAR, FAR]
    for given in roles:
        costs, _ = _step(costs, given)
    return min(c + ENDS[s][0] for s, c in enumerate(costs))


#: What could be read as a header in a turn's text: it gets a backslash more, so that no text forges a turn.
_OPENING = re.compile(r"<(\\*)\|")
_HEADER = re.compile(rf"<\|({'|'.join(ROLES)})\|>\n")


def escape(text: str) -> str:
    return _OPENING.sub(lambda m: f"<\\{m[1]}|", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation, as they were before they were escaped."""
    parts = _HEADER.split(rendered)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text.removesuffix("\n"))) for role, text in zip(parts[1::2], parts[2::2])]


def header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def render(role: int, merged: bool, empty: tuple, text: str | None, last_state: int | None) -> tuple[str, int]:
    """Text of a turn and its number of empty turns; last_state: the end state at a conversation's last turn."""
    end = () if last_state is None else ENDS[last_state][1]
    parts = [f"{header(r)}\n" for r in empty]
    parts.append("\n" if merged else header(role))
    parts.append(f"{escape(text or '')}\n")
    parts += [f"{header(r)}\n" for r in end]
    return "".join(parts), len(empty) + len(end)


CHUNK_SCHEMA = (
    "part int, seq int, convs array<long>, turns array<long>, roles array<string>, texts array<string>, "
    "first_conv long, first_n int, first_m array<long>, last_conv long, last_n int, last_m array<long>"
)
OUT_SCHEMA = "conv_id long, turn long, pos long, role string, new_role string, action string, n_inserted int, cost long, rendered string"


def _segments(convs: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(convs)) if convs[i] != convs[i - 1]], len(convs)]
    return list(zip(cuts, cuts[1:]))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_turns: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, held, size
        convs, turns, roles, texts = held
        segments = _segments(convs)
        (a, b), (c, d) = segments[0], segments[-1]
        kinds = [role_of(r) for r in roles]
        one = len(segments) == 1
        row = {
            "part": part, "seq": seq, "convs": convs, "turns": turns, "roles": roles, "texts": texts,
            "first_conv": convs[a], "first_n": b - a, "first_m": matrix(kinds[a:b]),
            "last_conv": None if one else convs[c], "last_n": None if one else d - c, "last_m": None if one else matrix(kinds[c:d]),
        }
        seq, held, size = seq + 1, ([], [], [], []), 0
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for column, value in zip(held, (conv, turn, role, text)):
                column.append(value)
            size += len(text or "")
            if len(held[0]) >= chunk_turns or size >= CHUNK_BYTES:
                yield flush()
    if held[0]:
        yield flush()


def _along(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunks' parts of one conversation, in order: states at the cuts and places."""
    pdf = pdf.sort_values(["part", "seq"], kind="stable").reset_index(drop=True)
    costs, before = [0, FAR, FAR, FAR], []
    for m in pdf["m"]:
        before.append(costs)
        costs = [min(min(costs[s] + int(m[4 * s + t]) for s in range(4)), FAR) for t in range(4)]
    state = min(range(4), key=lambda s: (costs[s] + ENDS[s][0], s))
    least = costs[state] + ENDS[state][0]
    starts, ends = [0] * len(pdf), [0] * len(pdf)
    for k in range(len(pdf) - 1, -1, -1):
        ends[k], m = state, pdf["m"][k]
        state = min(range(4), key=lambda s: (before[k][s] + int(m[4 * s + state]), s))
        starts[k] = state
    offset = pdf["n"].cumsum() - pdf["n"]
    return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "which": pdf["which"], "start": starts, "end": ends, "offset": offset.astype("int64"), "final": [k == len(pdf) - 1 for k in range(len(pdf))], "cost": least})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "pos", "role", "new_role", "action", "n_inserted", "cost", "rendered"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            segments = _segments(row["convs"])
            for k, (a, b) in enumerate(segments):
                cut = row["first"] if k == 0 else row["last"] if k == len(segments) - 1 else None
                kinds = [role_of(r) for r in row["roles"][a:b]]
                if cut is None:
                    path, offset, final, cost = repair(kinds), 0, True, total_cost(kinds)
                else:
                    path, offset, final, cost = repair(kinds, cut["start"], cut["end"]), cut["offset"], cut["final"], cut["cost"]
                for i, (role, merged, empty) in enumerate(path):
                    end = role + 1 if final and i == b - a - 1 else None
                    rendered, n = render(role, merged, empty, row["texts"][a + i], end)
                    action = "+".join(x for x, yes in (("merge", merged), ("relabel", kinds[i] != role), ("insert", n > 0)) if yes) or "keep"
                    out.append((row["convs"][a + i], row["turns"][a + i], offset + i, row["roles"][a + i], ROLES[role], action, n, cost, rendered))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def format_chats(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, turn, pos, role, new_role, action, n_inserted, cost (of the conversation), rendered: a row per turn.

    Turns go by turn (nulls first), equal ones by role and text; repeated rows all count. Null conv_id: one
    conversation. Null or empty text: an empty turn. Null or unknown role: takes the cheapest role. Very long texts
    make chunks of one turn. Empty table: no rows. Other columns are ignored.
    """
    spark = conversations.sparkSession
    keys = ["conv_id", "turn", "role", "h", "row"]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")
    chunks = materialize(dealt.mapInArrow(lambda batches: _chunks(batches, chunk_turns), CHUNK_SCHEMA), "chat-chunks", row_group_bytes=16 << 20)

    first = chunks.select("part", "seq", F.lit("first").alias("which"), F.col("first_conv").alias("conv"), F.col("first_n").alias("n"), F.col("first_m").alias("m"))
    last = chunks.filter("last_n is not null").select("part", "seq", F.lit("last").alias("which"), F.col("last_conv").alias("conv"), F.col("last_n").alias("n"), F.col("last_m").alias("m"))
    found = first.unionByName(last).groupBy("conv").applyInPandas(_along, "part int, seq int, which string, start int, end int, offset long, final boolean, cost long")
    cut = F.struct("start", "end", "offset", "final", "cost")
    cuts = found.groupBy("part", "seq").agg(F.first(F.when(F.col("which") == "first", cut), ignorenulls=True).alias("first"), F.first(F.when(F.col("which") == "last", cut), ignorenulls=True).alias("last"))
    return chunks.drop("first_conv", "first_n", "first_m", "last_conv", "last_n", "last_m").join(cuts, ["part", "seq"]).select("convs", "turns", "roles", "texts", "first", "last").mapInArrow(_repaired, OUT_SCHEMA)
