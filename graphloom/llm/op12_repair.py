"""Conversation structure repair by a time-major tensor programme.

The roles of a repaired conversation follow `(s?(ua)+)?`: four states (nothing yet, after system, after
user, after assistant), and from each exactly one of user and assistant may come next. So an edit (delete,
insert, keep, rerole) decides the next state, and a row's edits are a choice among four.

Each task takes the conversations of its partition in batches, buckets them by length and lays a bucket
out time-major: the costs of all its conversations in all states are brought back one turn at a time, all
turns' costs are kept, and the edits are traced forward for all conversations at once, each step taking
the least letter among the edits that keep the cost. Conversations are dealt by id and never held whole
when they are long: beyond LONG turns or BYTES of text their rows are written to a table, repeats are
found by a distributed grouping, one byte a turn (the size of the audit that is returned) goes through the
programme piece by piece, and the texts are hashed as a sorted stream, as SHA-256 is one chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, join_checked

#: Fixed values of the programme: costs of edits, states (0 none, 1 system, 2 user, 3 assistant).
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 40
NEXT = np.array([2, 2, 3, 2])
#: State after keeping a row of initial s, u, a or another; 4 is none.
KEEP = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
ROLE = {2: "user", 3: "assistant"}

#: Turns and bytes of text from which a conversation goes the long way, rows of a batch, turns of a piece.
LONG, BYTES, ROWS, PIECE = 4096, 16 << 20, 16_384, 65_536

#: Bits of a row's flags: initial (2 bits), blank, truncated, repeated; -1 is a row that was dropped.
BLANK, CUT, REPEATED = 4, 8, 16

_STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SCHEMA = f"{_STATS}, spilled boolean, at long, turn long, role string, text string, flags int"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the remainder of crc32(conv_id:turn) by 20: 0 drops the row,
    1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Null role and text, and
    nulls in what is hashed, count as one space. A dropped row stays with dropped = true, without text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, F.lit("")).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("time")).drop("time")


def _flags(rows: DataFrame) -> DataFrame:
    """With flags, from role, text and dropped."""
    end = F.right(F.expr(r"trim(TRAILING ' \t\n\u000B\u000C\r' FROM text)"), F.lit(1))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("flags", F.when(F.col("dropped"), -1).otherwise(initial + fault).cast("int")).drop("dropped")


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs where up to two turns may be inserted first; more never pay."""
    return np.minimum(cost, np.minimum(INSERT + cost[:, NEXT], 2 * INSERT + cost[:, NEXT[NEXT]]))


#: Costs at the end: nothing and after assistant are accepted.
FINAL = _inserted(np.array([[0, NEVER, NEVER, 0]], np.int64))[0]


def backward(flags: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """flags: turns x conversations; end: costs by state after the last turn. Returns the least cost onward
    before each turn: turns + 1 x conversations x states."""
    turns, n = flags.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        after, f = costs[t + 1], flags[t]
        more = np.where(f & (BLANK | REPEATED), NEVER, np.where(f & CUT, TRUNCATED, 0))[:, None]
        known = np.concatenate([after, np.full((n, 1), NEVER)], axis=1)
        kept = np.take_along_axis(known, KEEP.T[f & 3], axis=1) + more
        best = np.minimum(np.minimum(after + DELETE, kept), after[:, NEXT] + REROLE + more)
        costs[t] = np.where((t < lengths)[:, None], _inserted(best), after)
    return costs


def trace(costs: np.ndarray, flags: np.ndarray, lengths: np.ndarray, state: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits of all conversations, the least letters first: steps x conversations (0 where one
    has ended), and the states that they end in. Without `final`, more turns follow the last one."""
    n = len(lengths)
    state, at, who, steps = state.copy(), np.zeros(n, int), np.arange(n), []
    alive = np.ones(n, bool)
    while True:
        now = costs[at, who, state]
        alive &= (at < lengths) | ((now > 0) if final else False)
        if not alive.any():
            return np.array(steps, np.uint8).reshape(-1, n), state
        row = np.minimum(at, max(len(flags) - 1, 0))
        f = flags[row, who] if len(flags) else np.zeros(n, int)
        within, onward = at < lengths, np.minimum(at + 1, len(costs) - 1)
        more = np.where(f & (BLANK | REPEATED), NEVER, np.where(f & CUT, TRUNCATED, 0))
        kept = KEEP[state, f & 3]
        delete = within & (costs[onward, who, state] + DELETE == now)
        insert = costs[at, who, NEXT[state]] + INSERT == now
        keep = within & (kept < 4) & (costs[onward, who, np.minimum(kept, 3)] + more == now)
        step = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
        to = np.where(step == ord("D"), state, np.where(step == ord("K"), np.minimum(kept, 3), NEXT[state]))
        steps.append(np.where(alive, step, 0))
        state = np.where(alive, to, state)
        at = at + (alive & (step != ord("I")))


def repair_all(flags: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(cost, audit) of each conversation: buckets of about equal length, one tensor each."""
    lengths = np.array([len(f) for f in flags])
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    out: list = [None] * len(flags)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        size = lengths[members]
        grid = np.zeros((size.max(), len(members)), int)
        for k, m in enumerate(members):
            grid[: size[k], k] = flags[m]
        costs = backward(grid, size, FINAL)
        steps, _ = trace(costs, grid, size, np.zeros(len(members), int), True)
        for k, m in enumerate(members):
            edits = steps[:, k]
            out[m] = int(costs[0, k, 0]), edits[edits > 0].tobytes()
    return out


def repair_long(flags: np.ndarray, piece: int = PIECE) -> tuple[int, bytes]:
    """(cost, audit) of one conversation of any length: costs are kept at the edges of pieces, and made again
    within one piece at a time on the way forward."""
    edges = list(range(0, len(flags), piece)) or [0]
    grid = lambda at: flags[at : at + piece].astype(int)[:, None]
    size = lambda at: np.array([len(flags[at : at + piece])])
    ends = {edges[-1]: FINAL[None, :]}
    for before, at in zip(reversed(edges[:-1]), reversed(edges[1:])):
        ends[before] = backward(grid(at), size(at), ends[at])[0]
    state, audit, cost = np.zeros(1, int), [], 0
    for at in edges:
        costs = backward(grid(at), size(at), ends[at])
        cost = cost if at else int(costs[0, 0, 0])
        steps, state = trace(costs, grid(at), size(at), state, at == edges[-1])
        audit.append(steps[:, 0].tobytes())
    return cost, b"".join(audit)


class Writer:
    """The repaired turns `role:text` of one conversation, as its audit says."""

    def __init__(self, audit: bytes):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        self.state = int(NEXT[self.state])
        return ROLE[self.state]

    def inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == b"I":
            self.at += 1
            yield f"{self._next()}:"

    def turn(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at : self.at + 1], self.at + 1
        if edit == b"K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield f"{role}:{text}"
        elif edit == b"R":
            yield f"{self._next()}:{text}"


class Hash:
    """SHA-256 of turns joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[str]) -> None:
        for turn in turns:
            self.sha.update((b"\n" if self.any else b"") + turn.encode())
            self.any = True


class Counts:
    """Faults, illegal neighbours and gaps, row by row."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, flags: int, turn) -> None:
        if flags & BLANK:
            self.blank += 1
        elif flags & REPEATED:
            self.duplicate += 1
        elif flags & CUT:
            self.truncated += 1
        initial = flags & 3
        if self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            # Rows come by turn, nulls first.
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


_ARROW = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("spilled", pa.bool_()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("flags", pa.int32())])


def _finished(held: list[tuple]) -> pa.RecordBatch:
    """(conv_id, turn, role, text, flags) of whole conversations, in order -> their results."""
    found, at = [], 0
    while at < len(held):
        conv, rows = held[at][0], []
        while at < len(held) and held[at][0] == conv:
            if held[at][4] >= 0:
                rows.append(held[at])
            at += 1
        seen, flags, counts = set(), [], Counts()
        for _, turn, role, text, f in rows:
            if not f & BLANK and (role, text) in seen:
                f |= REPEATED
            seen.add((role, text))
            flags.append(f)
            counts.add(f, turn)
        found.append((conv, rows, np.array(flags, int), counts))
    results = repair_all([f for _, _, f, _ in found])
    out = []
    for (conv, rows, _, counts), (cost, audit) in zip(found, results):
        writer, digest = Writer(audit), Hash()
        for _, _, role, text, _ in rows:
            digest.add(writer.turn(role, text))
        digest.add(writer.inserted())
        out.append({"conv_id": conv, **counts.row(), "cost": cost, "audit": audit.decode(), "repaired_sha256": digest.sha.hexdigest(), "spilled": False})
    return pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _stream(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> results of conversations, and the rows of long ones, numbered."""
    done, done_size, open_, size, spilled = [], 0, [], 0, 0
    current, begun = None, False

    def spill(rows: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "turn", "role", "text", "flags")
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r), spilled=True, at=first + at + k) for k, r in enumerate(rows[at : at + 1000])], schema=_ARROW)

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            names = part.schema.names
            for row in zip(*(part.column(names.index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "flags"))):
                if not begun or row[0] != current:
                    if spilled:
                        yield from spill(open_, spilled)
                    else:
                        done.extend(open_)
                        done_size += size
                    if len(done) >= ROWS or done_size > BYTES:
                        yield _finished(done)
                        done, done_size = [], 0
                    current, begun, open_, size, spilled = row[0], True, [], 0, 0
                open_.append(row)
                size += len(row[3])
                if len(open_) >= long or size > BYTES:
                    yield from spill(open_, spilled)
                    spilled, open_, size = spilled + len(open_), [], 0
    if spilled:
        yield from spill(open_, spilled)
    else:
        done += open_
    if done:
        yield _finished(done)


def _by_conversation(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], begin, add, end) -> Iterator[pa.RecordBatch]:
    """A sorted stream of rows folded conversation by conversation: one state at a time is held."""
    current, state = None, None
    for batch in batches:
        names = batch.schema.names
        for conv, *values in zip(*(batch.column(names.index(c)).to_pylist() for c in ("conv_id", *columns))):
            if state is None or conv != current:
                if state is not None:
                    yield pa.RecordBatch.from_pylist([end(current, state)], schema=_ARROW)
                current, state = conv, begin()
            add(state, *values)
    if state is not None:
        yield pa.RecordBatch.from_pylist([end(current, state)], schema=_ARROW)


def _audit_stream(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    def add(state, turn, flags):
        if flags >= 0:
            state[0].append(flags)
            state[1].add(flags, turn)

    def end(conv, state):
        cost, audit = repair_long(np.frombuffer(bytes(state[0]), np.uint8), piece)
        return {"conv_id": conv, **state[1].row(), "cost": cost, "audit": audit.decode()}

    return _by_conversation(batches, ("turn", "flags"), lambda: (bytearray(), Counts()), add, end)


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def add(state, audit, role, text, flags):
        if audit is not None:
            state[0] = Writer(audit.encode())
        elif flags >= 0:
            state[1].add(state[0].turn(role, text))

    def end(conv, state):
        state[1].add(state[0].inserted())
        return {"conv_id": conv, "repaired_sha256": state[1].sha.hexdigest()}

    return _by_conversation(batches, ("audit", "role", "text", "flags"), lambda: [None, Hash()], add, end)


def _long_way(rows: DataFrame, piece: int) -> DataFrame:
    """conv_id, at, turn, role, text, flags of long conversations -> their results."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.select("conv_id", "at", "turn", "flags", same.alias("same"))
    first = (
        keyed.where(f"flags >= 0 and flags & {BLANK} = 0").groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("conv_id").alias("of"), F.col("same").alias("of_same"), "first")
    )
    first = cut(first, "first")
    marked = join_checked(keyed, first, (F.col("same") == F.col("of_same")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    repeated = F.when((F.col("at") > F.col("first")) & (F.col("flags") >= 0) & (F.col("flags").bitwiseAND(BLANK) == 0), REPEATED).otherwise(0)
    narrow = marked.select("conv_id", "at", "turn", (F.col("flags") + repeated).cast("int").alias("flags"))
    ordered = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    audits = cut(ordered(narrow).mapInArrow(partial(_audit_stream, piece=piece), _SCHEMA).select(*_names()[:8]), "audits")
    told = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("flags"))
    texts = rows.select("conv_id", "at", F.lit(None).cast("string").alias("audit"), "role", "text", "flags")
    hashes = ordered(told.unionByName(texts)).mapInArrow(_hash_stream, _SCHEMA).select(F.col("conv_id").alias("of"), "repaired_sha256")
    return audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).select(*_names())


def _names() -> list[str]:
    return [c.split()[0] for c in _STATS.split(", ")]


def repair(rows: DataFrame, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """conv_id, turn, role, text and dropped (rows that are gone but whose conversation is reported) -> one
    row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are ordered by turn (nulls first), then role and text. A null conv_id is a conversation of its
    own. A conversation without rows has zeros, an empty audit and the hash of the empty string, as has
    one whose rows are all deleted (but for its counts). Roles other than those that begin with s, u or a
    cannot be kept. An empty table gives an empty result; further columns are ignored.
    """
    flagged = _flags(rows.select("conv_id", "turn", "role", "text", "dropped"))
    ordered = flagged.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    out = cut(ordered.mapInArrow(partial(_stream, long=long), _SCHEMA), "repaired")
    short, spilled = out.where("not spilled").select(*_names()), out.where("spilled").select("conv_id", "at", "turn", "role", "text", "flags")
    return short if spilled.isEmpty() else short.unionByName(_long_way(spilled, piece))


def query(spark, sf_dir):
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    """The programme as a recursive query: one turn a step, for each state the least (cost, audit, repaired turns)."""
    step = lambda x, cost, letter, text: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text.replace('@', x)}}}"
    insert = lambda x, role: step(x, INSERT, "I", f"list_append(@.t, '{role}:')")
    least = lambda *found: f"least({', '.join(found)})"
    inserted = lambda source: (
        f"SELECT * REPLACE ({least('u', *[insert(x, 'user') for x in ('z', 's', 'a')])} AS u, {least('a', insert('u', 'assistant'))} AS a) FROM ({source})"
    )
    before = inserted(inserted("SELECT f.conv, f.n + 1 AS n, f.z, f.s, f.u, f.a, r.role, r.text, r.initial, r.fault FROM fold f JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM f.conv AND r.n = f.n + 1"))
    must, more = "coalesce(fault, '') IN ('blank', 'duplicate')", f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    delete = lambda x: step(x, DELETE, "D", "@.t")
    kept = "list_append(@.t, role || ':' || text)"
    keep = lambda x, initial: f"CASE WHEN initial = '{initial}' AND NOT {must} THEN {step(x, more, 'K', kept)} ELSE {never} END"
    rerole = lambda x, role: f"CASE WHEN NOT {must} THEN {step(x, f'{REROLE} + {more}', 'R', f"list_append(@.t, '{role}:' || text)")} ELSE {never} END"
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    to_user = [f(x) for x in ("z", "s", "a") for f in (lambda x: keep(x, "u"), lambda x: rerole(x, "user"))]
    ended = inserted(inserted("SELECT f.* FROM fold f JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM f.conv AND sizes.n = f.n"))
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(generate_series(1, 8), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    4294967295), 4294967295) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM kinds),
ordered AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
numbered AS (SELECT *, CASE WHEN last = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM ordered),
sizes AS (SELECT i.conv_id, count(r.n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY i.conv_id),
fold AS (SELECT conv_id AS conv, CAST(0 AS BIGINT) AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS z, {never} AS s, {never} AS u, {never} AS a FROM sizes
  UNION ALL SELECT conv, n, {delete('z')}, {least(delete('s'), keep('z', 's'))}, {least(delete('u'), *to_user)},
    {least(delete('a'), keep('u', 'a'), rerole('u', 'assistant'))} FROM ({before})),
best AS (SELECT conv, least(z, a) AS e FROM ({ended}))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, e.c AS cost, e.a AS audit, sha256(array_to_string(e.t, chr(10))) AS repaired_sha256
FROM sizes JOIN best ON best.conv IS NOT DISTINCT FROM sizes.conv_id
"""


ORACLE = _oracle()
