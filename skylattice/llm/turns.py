"""Repair of conversation structure by the cheapest edits, found from both ends of an edit lattice.

A node of the lattice is a number of rows read and a state of the wanted order of roles: an optional system turn, then
pairs of user and assistant. Keep, Rerole and Delete read a row, Insert does not. Two Dijkstra searches, one from the first
node and one against the edges from the accepting nodes, take turns until their least open costs exceed the best
crossing together; all crossings of that cost are finished by then. Every node of a cheapest path is settled by one of the
searches, so the least audit is read off what both have settled.

The searches see one small code for each row. Texts pass once in order, for the repaired conversation's digest, and are
never held together. Conversations are streamed from sorted partitions, so that one of any length needs about 30 bytes a row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Row codes: 4 * role + fault. Roles: another initial, s, u, a. Faults: none, blank, duplicate, truncated.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after system, after user, after assistant; the state that each role leads to from each.
_AFTER = [[None, 1, 2, None], [None, None, 2, None], [None, None, None, 3], [None, None, 2, None]]
_ENDS = (0, 3)
WHITE = "\\x20\\x09-\\x0D"
#: Solved short conversations that a task remembers.
REMEMBERED = 1 << 14


def edits_from(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that read a row of this code."""
    role, fault = divmod(code, 4)
    if fault not in (BLANK, DUPLICATE):
        cut = CUT if fault == TRUNCATED else 0
        if _AFTER[state][role] is not None:
            yield "K", cut, _AFTER[state][role]
        for to in (USER, ASSISTANT):
            if _AFTER[state][to] is not None:
                yield "R", RETYPE + cut, _AFTER[state][to]
    yield "D", DELETE, state


def inserts_from(state: int) -> Iterator[tuple[str, int, int]]:
    for to in (USER, ASSISTANT):
        if _AFTER[state][to] is not None:
            yield "I", INSERT, _AFTER[state][to]


_READS = [[list(edits_from(code, state)) for state in range(4)] for code in range(16)]
_STAYS = [list(inserts_from(state)) for state in range(4)]
_READS_BACK = [[[(e, c, state) for state in range(4) for e, c, to in _READS[code][state] if to == target] for target in range(4)] for code in range(16)]
_STAYS_BACK = [[(e, c, state) for state in range(4) for e, c, to in _STAYS[state] if to == target] for target in range(4)]


class _Search:
    """One of the two searches; node 4 * rows read + state."""

    def __init__(self, starts: list[int], codes: bytes, forward: bool):
        self.codes, self.forward = codes, forward
        self.cost = dict.fromkeys(starts, 0)
        self.done: dict[int, int] = {}
        self.heap = [(0, s) for s in starts]

    def top(self) -> int | None:
        while self.heap and self.heap[0][1] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int]:
        cost, node = heapq.heappop(self.heap)
        self.done[node] = cost
        read, state = divmod(node, 4)
        if self.forward:
            steps = [(c, node - state + to) for _, c, to in _STAYS[state]]
            if read < len(self.codes):
                steps += [(c, node - state + 4 + to) for _, c, to in _READS[self.codes[read]][state]]
        else:
            steps = [(c, node - state + to) for _, c, to in _STAYS_BACK[state]]
            if read:
                steps += [(c, node - state - 4 + to) for _, c, to in _READS_BACK[self.codes[read - 1]][state]]
        for c, to in steps:
            if cost + c < self.cost.get(to, cost + c + 1):
                self.cost[to] = cost + c
                heapq.heappush(self.heap, (cost + c, to))
        return node, cost


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of edits, and of the cheapest audits the one that is least in ASCII order."""
    last = 4 * len(codes)
    ahead, back = _Search([0], codes, True), _Search([last + e for e in _ENDS], codes, False)
    best = None
    while (a := ahead.top()) is not None and (b := back.top()) is not None and (best is None or a + b <= best):
        own, other = (ahead, back) if len(ahead.heap) <= len(back.heap) else (back, ahead)
        node, cost = own.settle()
        if node in other.cost and (best is None or cost + other.cost[node] < best):
            best = cost + other.cost[node]
    # what is left to pay at each settled node of a cheapest path; those known from the front alone must reach another such node
    left = {node: best - cost for node, cost in ahead.done.items()} | back.done
    choice: dict[int, tuple[str, int]] = {}
    after: dict[int, int] = {}
    for read in range(len(codes), -1, -1):
        # the nodes of this row in the order of their least audits from here; equal ones in any order
        ordered: list[int] = []

        def key(node: int, after: dict[int, int] = after, ordered: list[int] = ordered) -> tuple[str, int]:
            letter, to = choice.get(node, ("", 0))
            return letter, ordered.index(to) if letter == "I" else after.get(to, 0)

        for cost, node in sorted((left[n], n) for n in range(4 * read, 4 * read + 4) if n in left):
            if cost or read < len(codes) or node - last not in _ENDS:
                options = [(e, ordered.index(to), to) for e, c, s in _STAYS[node % 4] if (to := 4 * read + s) in ordered and left[to] + c == cost]
                if read < len(codes):
                    options += [(e, after[to], to) for e, c, s in _READS[codes[read]][node % 4] if (to := 4 * read + 4 + s) in after and left[to] + c == cost]
                if not options:
                    continue
                choice[node] = min(options)[::2]
            ordered.insert(sum(key(n) < key(node) for n in ordered), node)
        after = {n: i for i, n in enumerate(ordered)}
    audit, node = [], 0
    while node in choice:
        letter, node = choice[node]
        audit.append(letter)
    return best, "".join(audit)


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` after the damage that crc32 of `conv_id:turn` chooses; dropped rows stay, marked.

    Nulls count as one space in the checksum, in roles and in texts.
    """
    kind = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    role, text = _text("role"), _text("text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("dropped"), kind.alias("kind"))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _coded(rows: DataFrame) -> DataFrame:
    """A row's order, hashes of role and text, and what one row alone tells; no texts."""
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), BLANK).when(F.col("text").rlike(f"[.!?][{WHITE}]*\\z"), FINE).otherwise(TRUNCATED)
    return rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), role.cast("byte").alias("role"), fault.cast("byte").alias("fault"), "dropped")


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "h1", "h2")


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, of the size of a batch unless a conversation is larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _borders(batch.column(0))
        if held and (held[-1].column(0)[-1] != batch.column(0)[0]) and not (held[-1].column(0)[-1].as_py() is None and batch.column(0)[0].as_py() is None):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(new) > 1:
            at = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _borders(ids: pa.Array) -> np.ndarray:
    """Where runs of equal ids start; nulls are equal."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], 1 + np.flatnonzero(codes[1:] != codes[:-1])))


class _Solver:
    """`cheapest` with a bounded memory for short conversations."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, str]] = {}

    def __call__(self, codes: bytes) -> tuple[int, str]:
        if len(codes) > 32:
            return cheapest(codes)
        if codes not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[codes] = cheapest(codes)
        return self.known[codes]


def _judge(table: pa.Table, solve: _Solver) -> Iterator[dict]:
    """Counts and the cheapest edits of each conversation of the table."""
    ids = table.column(0).combine_chunks()
    borders = _borders(ids)
    known = ~pc.is_null(table.column(1)).to_numpy()
    turn = pc.fill_null(table.column(1), 0).to_numpy()
    h1, h2, role, fault, dropped = (table.column(i).to_numpy() for i in range(2, 7))
    owner = np.repeat(np.arange(len(borders)), np.diff(np.append(borders, len(turn))))
    order = np.lexsort((np.arange(len(turn)), h2, h1, dropped, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (owner[order][1:] == owner[order][:-1]) & (dropped[order][1:] == dropped[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    repeats = np.zeros(len(order), bool)
    repeats[order] = again
    code = (4 * role + np.where((fault != BLANK) & repeats, DUPLICATE, fault)).astype(np.uint8)
    for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(turn)], strict=True):
        stay = ~dropped[a:b]
        own, when = code[a:b][stay], turn[a:b][stay & known[a:b]]
        faults, pair = own % 4, (own[:-1] // 4) * 4 + own[1:] // 4
        cost, audit = solve(own.tobytes())
        yield {"conv_id": ids[a].as_py(), "gaps": int(when.max()) - int(when.min()) + 1 - len(np.unique(when)) if len(when) else 0, "blank": int((faults == BLANK).sum()), "duplicate": int((faults == DUPLICATE).sum()),
               "truncated": int((faults == TRUNCATED).sum()), "illegal": int((~np.isin(pair, (4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER))).sum()), "cost": cost, "audit": audit}


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of each row of the repaired conversation, one after another."""
    odd = sum(e != "D" for e in audit) % 2
    at = 0
    for e in audit:
        if e == "D":
            next(rows)
            continue
        role, text = ("", "") if e == "I" else next(rows)
        if e != "K":
            role = "assistant" if (at - odd) % 2 else "user"
        yield role, text
        at += 1


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts and the audit of every conversation of `damaged` rows, or of any rows with a `dropped` mark."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = _Solver()
        for table in _whole_conversations(batches):
            found = list(_judge(table, solve))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in
                                              [("conv_id", table.schema.field(0).type), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]], ["conv_id", *_COUNTS, "audit"])

    return _in_order(_coded(rows)).mapInArrow(judge, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """`audits` with `repaired_sha256`, the SHA-256 of the repaired `role:text` rows joined by line ends.

    One row per conv_id, null included, also where all rows are dropped. Rows are ordered by turn, nulls first, and rows of one
    turn by hashes of role and text, so that repeated rows are neighbours. Null roles and texts are one space, which is blank.
    Roles count by their first character. Empty tables give no rows. Extra columns are ignored. Rows with equal
    role and text are known by two 64-bit hashes.
    """
    found = audits(rows)
    tagged = rows.where("NOT dropped").select("conv_id", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), "role", "text", F.lit(1).alias("part"),
                                              *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("part"), *_COUNTS)
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        stream = _stream(batches)
        head = next(stream, None)
        while head is not None:
            follower: list = []

            def own() -> Iterator[tuple[str, str]]:
                for row in stream:
                    if row[2]:
                        follower.append(row)
                        return
                    yield row[0], row[1]

            texts, sha, first = own(), hashlib.sha256(), True
            for role, text in repaired_rows(head[1], texts):
                sha.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            for _ in texts:  # the conversation's last rows may be deleted ones
                pass
            done.append((*head[2], head[1], sha.hexdigest()))
            head = follower[0] if follower else None
            if len(done) >= 4096 or head is None:
                yield _records(done, arrow)
                done = []

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    order = _in_order(heads.unionByName(tagged), "part")
    return order.select("part", "role", "text", "conv_id", *_COUNTS).mapInArrow(digest, schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(role, text, None) of rows and ("", audit, (conv_id, counts)) of the heads before them."""
    for batch in batches:
        heads = {i: r for i, r in zip(np.flatnonzero(batch.column(0).to_numpy() == 0).tolist(), batch.filter(pc.equal(batch.column(0), 0)).select(batch.schema.names[3:]).to_pylist(), strict=True)}
        for i, (role, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            yield role, text, tuple(heads[i].values()) if i in heads else None


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """`repaired` over the `damaged` conversations."""
    return repaired(damaged(conversations))
