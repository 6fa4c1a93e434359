"""Chat formatting by minimum-cost role repair.

The roles of a conversation must follow a legal-turn automaton: an optional
``system`` turn, then ``user`` and ``assistant`` in turn.  Each message is
emitted under some role (another than its own costs ``RELABEL``, or
``RELABEL_UNKNOWN`` where its role is none of the three), as a turn of its own
or merged into the turn before (``MERGE``); an empty turn may be inserted
before it (``INSERT``).  A dynamic program over the automaton's states finds
the cheapest repair, and the messages are rendered under it.

Messages are sorted by range of (conversation, turn), so a conversation that
holds a third of all messages is spread over many tasks.  A conversation that
lies within one partition is repaired there and then.  Of those that reach a
partition's edge, each partition tells the cheapest cost from every state to
every state (16 numbers); the driver chains these, two rows per partition at
most, into the states at the borders, and a second pass repairs the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, written

# fixed values: roles, costs and the template
ROLES = ("system", "user", "assistant")
MERGE, INSERT, RELABEL_UNKNOWN, RELABEL = 1.0, 2.0, 2.5, 3.0
#: State 0 is the start, state k the turn of ROLES[k - 1]; which state may follow which.
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
#: Cost of ending in a state: a lone system turn gets an empty user turn.
END = (0.0, INSERT, 0.0, 0.0)
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n\n"

STATES = range(len(ROLES) + 1)
_INF = float("inf")


def step(role: str | None) -> dict[tuple[int, int], tuple[float, str, int]]:
    """(state before, state after) -> (cost, action, inserted state or 0) for
    a message of this role.  At equal cost: plain turn, merge, insertion."""
    out = {}
    for new in STATES[1:]:
        label = 0.0 if ROLES[new - 1] == role else RELABEL if role in ROLES else RELABEL_UNKNOWN
        for old in STATES:
            ways = []
            if (old, new) in LEGAL:
                ways.append((label, 0, "turn", 0))
            if old == new:
                ways.append((label + MERGE, 1, "merge", 0))
            ways += [(label + INSERT, 2, "insert", y) for y in STATES[1:] if (old, y) in LEGAL and (y, new) in LEGAL]
            if ways:
                cost, _, action, y = min(ways)
                out[old, new] = cost, action, y
    return out


_STEPS = {r: step(r) for r in (*ROLES, None)}


def _steps(role):
    return _STEPS[role if role in ROLES else None]


def costs(roles, entry: int | None = None) -> list[list[float]]:
    """Least cost from each state (or from ``entry`` alone) to each state."""
    rows = []
    for start in STATES if entry is None else [entry]:
        now = [_INF] * len(STATES)
        now[start] = 0.0
        for r in roles:
            new = [_INF] * len(STATES)
            for (a, b), (c, _, _) in _steps(r).items():
                if now[a] + c < new[b]:
                    new[b] = now[a] + c
            now = new
        rows.append(now)
    return rows


def path(roles, entry: int, leave: int | None) -> list[tuple[int, float, str, int]]:
    """(state, cost, action, inserted state) per message; ``leave`` None: the
    conversation ends here."""
    now = [_INF] * len(STATES)
    now[entry] = 0.0
    back = []
    for r in roles:
        new, came = [_INF] * len(STATES), [0] * len(STATES)
        for (a, b), (c, _, _) in _steps(r).items():
            if now[a] + c < new[b]:
                new[b], came[b] = now[a] + c, a
        now = new
        back.append(came)
    state = leave if leave is not None else min(STATES, key=lambda s: (now[s] + END[s], s))
    out = []
    for r, came in zip(reversed(roles), reversed(back), strict=True):
        old = came[state]
        cost, action, y = _steps(r)[old, state]
        out.append((old, state, cost, action, y))
        state = old
    return [x[1:] for x in reversed(out)]


def chain(pieces: list[list[list[float]]]) -> list[tuple[int, int | None]]:
    """Entry and exit state of each piece of one conversation, in order."""
    now, back = [0.0, *[_INF] * len(ROLES)], []
    for m in pieces:
        came = [min(STATES, key=lambda a, b=b, now=now, m=m: (now[a] + m[a][b], a)) for b in STATES]
        now = [now[came[b]] + m[came[b]][b] for b in STATES]
        back.append(came)
    state = min(STATES, key=lambda s: (now[s] + END[s], s))
    out: list[tuple[int, int | None]] = []
    for k in reversed(range(len(pieces))):
        entry = back[k][state]
        out.append((entry, state if k < len(pieces) - 1 else None))
        state = entry
    return out[::-1]


def rendered(roles, texts, entry: int, leave: int | None):
    """Per message: (new role, action, inserted role, cost, piece of the
    rendered conversation); the pieces in order are the conversation."""
    out, old = [], entry
    steps = path(roles, entry, leave)
    for k, ((state, cost, action, y), text) in enumerate(zip(steps, texts, strict=True)):
        name, piece = ROLES[state - 1], text or ""
        if action == "merge":
            piece = JOIN + piece
        else:
            before = (CLOSE if old else "") + (OPEN.format(ROLES[y - 1]) + CLOSE if y else "")
            piece = before + OPEN.format(name) + piece
        inserted = ROLES[y - 1] if y else None
        if leave is None and k == len(steps) - 1:
            piece += CLOSE
            if END[state]:
                piece += OPEN.format(ROLES[1]) + CLOSE
                cost += END[state]
        out.append((name, action, inserted, cost, piece))
        old = state
    return out


_OUT = "conv string, seq long, turn long, role string, new_role string, action string, inserted_role string, cost double, piece string"
#: Messages of conversations at a partition's edge wait, with their place, and so does that piece's cost table.
_SORTED = _OUT + ", text string, part int, edge int, costs array<double>"


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per message: conv_id, seq (its place in the conversation, from
    0), turn, role, new_role, action (turn, merge or insert), inserted_role
    (of the empty turn put before it), cost, piece (its part of the rendered
    conversation: the pieces in seq order, joined, are the whole).

    Messages are ordered by turn (null first), then role and text; equal rows
    are messages of their own.  Roles are compared without case or outer
    blanks; null and other roles are relabelled; null text counts as empty;
    messages without a conv_id are one conversation.  Conversations end in a
    user or assistant turn.  An empty table gives no rows; other columns are
    not read.
    """
    spark = messages.sparkSession
    small_batches(spark)
    kind = messages.schema[conv_col].dataType
    # text order of the ids serves: only equality matters
    m = messages.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
                        F.monotonically_increasing_id().alias("r"))
    order = ["conv", "turn", "role", F.xxhash64("text"), "r"]
    m = m.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")

    out_schema, waiting_schema = (to_arrow_schema(T.StructType.fromDDL(x)) for x in (_OUT, _SORTED))

    def batch_of(rows, names, schema):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names, strict=True)], names=names)

    def conversations(batches):
        """(conv, turns, roles, texts) of runs of equal conv."""
        held = None
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        yield held
                    held = (conv, [], [], [])
                for side, x in zip(held[1:], (turn, role, text), strict=True):
                    side.append(x)
        if held is not None:
            yield held

    def plain(roles):
        return [r.strip().lower() if r is not None else None for r in roles]

    def solved(conv, turns, roles, texts, entry, leave, first):
        return [(conv, first + k, t, r, *x) for k, (t, r, x) in enumerate(zip(turns, roles, rendered(plain(roles), texts, entry, leave), strict=True))]

    def sort_pass(batches):
        from pyspark import TaskContext

        schema, names = waiting_schema, waiting_schema.names
        part = TaskContext.get().partitionId()

        def waiting(c, edge):
            conv, turns, roles, texts = c
            flat = [x for row in costs(plain(roles)) for x in row]
            yield (conv, len(turns), None, None, None, None, None, None, None, None, part, edge, flat)
            for k, (t, r, x) in enumerate(zip(turns, roles, texts, strict=True)):
                yield (conv, k, t, r, None, None, None, None, None, x, part, edge, None)

        rows, last, count = [], None, 0
        for c in conversations(batches):
            if last is not None:
                if count == 1:
                    rows += waiting(last, 1)
                else:
                    rows += [(*x, None, part, 0, None) for x in solved(*last, 0, None, 0)]
            if len(rows) >= 5000:
                yield batch_of(rows, names, schema)
                rows = []
            last, count = c, count + 1
        if last is not None:
            rows += waiting(last, 1 if count == 1 else 2)
        yield batch_of(rows, names, schema)

    done = written(m.mapInArrow(sort_pass, _SORTED), "chat-sorted")
    # two cost tables per partition at most; null cost means impossible, infinity survives as such
    pieces: dict = {}
    for r in sorted(done.filter("costs is not null").select("conv", "part", "edge", "seq", "costs").collect(), key=lambda r: (r["part"], r["edge"])):
        pieces.setdefault(r["conv"], []).append(r)
    ends = []
    for conv, own in pieces.items():
        n = len(STATES)
        tables = [[list(r["costs"][a * n: a * n + n]) for a in range(n)] for r in own]
        first = 0
        for r, (entry, leave) in zip(own, chain(tables), strict=True):
            ends.append((r["part"], r["edge"], entry, leave, first))
            first += r["seq"]
    ends = spark.createDataFrame(ends, "part int, edge int, entry int, leave int, first long")
    left = done.filter("edge > 0 and costs is null").select("part", "edge", "conv", F.col("seq").alias("k"), "turn", "role", "text")
    left = left.join(F.broadcast(ends), ["part", "edge"])
    left = left.repartition("part", "edge").sortWithinPartitions("part", "edge", "k")

    def edge_pass(batches):
        schema, names = out_schema, out_schema.names
        columns = ("part", "edge", "conv", "turn", "role", "text", "entry", "leave", "first")
        held, key = None, None

        def close():
            conv, entry, leave, first, turns, roles, texts = held
            return batch_of(solved(conv, turns, roles, texts, entry, leave, first), names, schema)

        for batch in batches:
            for part, edge, conv, turn, role, text, entry, leave, first in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (part, edge) != key:
                    if held is not None:
                        yield close()
                    held, key = (conv, entry, leave, first, [], [], []), (part, edge)
                for side, x in zip(held[4:], (turn, role, text), strict=True):
                    side.append(x)
        if held is not None:
            yield close()

    names = [f.split()[0] for f in _OUT.split(", ")]
    out = done.filter("edge = 0").select(*names).union(left.mapInArrow(edge_pass, _OUT))
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *names[1:])
