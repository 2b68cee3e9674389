"""Conversation repair: the cheapest edits that give a conversation legal roles.

Edits are K (keep a row, 0), R (give it role user or assistant, 2), D (delete it, 3; blank rows
and repeats must go) and I (insert an empty turn of user or assistant, 2); a truncated row that
stays costs 1 more. Legal are no rows, or user and assistant in turn, from a user to an
assistant, with at most one system row before them.

1. Rows are dealt out by conversation and sorted by turn; a task walks through its rows and
   holds none of them longer than their edit is open.
2. The dynamic program has four states: nothing yet, after a system, user or assistant row. A
   state's edits are a linked node, so states share the prefixes they have in common. A node
   has its ancestors at powers of two and a rolling hash of the edits up to it. Equal costs are
   decided by the first edit that differs: it is found by descent over those ancestors, and the
   edits before it are compared one by one where the nodes differ, as hashes may collide.
3. What all states share is settled: those edits are applied, written into the running SHA-256
   and forgotten. So memory follows the open rows, not the conversation; what grows with it are
   the audit itself, one byte an edit, and 16 bytes a row to find repeats. Conversations of more
   than ``LONG_ROWS`` rows have their repeats found by a keyed aggregate instead.

A SHA-256 has to be fed in order, so one task walks through each conversation, a long one too.

Defined results: a null conv_id is a conversation of its own; null turns come first and count
neither as gaps nor as distinct turns; a null role or text is one space (such a text is blank,
such a role has to be changed); rows of one turn come by role, then text, in UTF-8 order; every
row counts, also repeated ones; a conversation whose rows are all dropped, and only that, has
zeros, an empty audit and the hash of the empty string; an empty table gives no rows. Columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, short_batches, stage

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows of a conversation whose repeats are found within its task.
LONG_ROWS = 100_000
#: Nodes and bytes of text after which settled edits are looked for.
OPEN_NODES, OPEN_BYTES = 4096, 8_000_000
RELABEL_COST = INSERT_COST = 2
DELETE_COST = 3
MODULUS, BASE = (1 << 61) - 1, 1_000_003
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a user or an assistant row may follow.
BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}


class Edit:
    """The last of a sequence of edits; ``parent`` holds those before it."""

    __slots__ = ("parent", "letter", "depth", "code", "ups")

    def __init__(self, parent: Edit | None, letter: str, depth: int = 0, code: int = 0):
        self.parent, self.letter = parent, letter
        self.depth, self.code, self.ups = depth, code, []
        if parent is not None:
            self.depth = parent.depth + 1
            self.code = (parent.code * BASE + ord(letter)) % MODULUS
            up, k = parent, 0
            while True:
                self.ups.append(up)
                if k >= len(up.ups):
                    break
                up, k = up.ups[k], k + 1


def ancestor(edit: Edit, depth: int) -> Edit:
    while edit.depth > depth:
        k = min((edit.depth - depth).bit_length(), len(edit.ups)) - 1
        edit = edit.ups[k]
    return edit


def shared(a: Edit, b: Edit) -> Edit:
    """The last edit that both sequences have as the same node."""
    depth = min(a.depth, b.depth)
    a, b = ancestor(a, depth), ancestor(b, depth)
    if a is b:
        return a
    for k in range(len(a.ups) - 1, -1, -1):
        if k < len(a.ups) and a.ups[k] is not b.ups[k]:
            a, b = a.ups[k], b.ups[k]
    return a.parent


def letters(edit: Edit, root: Edit) -> str:
    found = []
    while edit is not root:
        found.append(edit.letter)
        edit = edit.parent
    return "".join(reversed(found))


def same(a: Edit, b: Edit) -> bool:
    """Whether two sequences of one length are equal, letter by letter up to a shared node."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.parent, b.parent
    return True


def sorts_before(a: Edit, b: Edit) -> bool:
    """Whether the edits up to ``a`` are less than those up to ``b``, in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = ancestor(a, depth), ancestor(b, depth)
    if x.code == y.code and same(x, y):
        return a.depth < b.depth
    if x.code != y.code:
        for k in range(len(x.ups) - 1, -1, -1):
            if k < len(x.ups) and x.ups[k].code != y.ups[k].code:
                x, y = x.ups[k], y.ups[k]
        if same(x.parent, y.parent):
            return x.letter < y.letter
    # sequences of one hash that differ: compare them as they are
    root = shared(a, b)
    return letters(a, root) < letters(b, root)


@dataclass
class Repair:
    """The walk through one conversation."""

    conv_id: int | None
    seen: set[bytes] = field(default_factory=set)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None

    def __post_init__(self) -> None:
        self.root = Edit(None, "")
        self.states: dict[int, tuple[int, Edit]] = {NOTHING: (0, self.root)}
        self.open_rows: list[tuple[str, str]] = []
        self.open_bytes, self.made = 0, 0
        self.node_room, self.byte_room = OPEN_NODES, OPEN_BYTES
        self.hash, self.audit = hashlib.sha256(), []
        self.last, self.wrote = NOTHING, False
        self.last_initial: str | None = None
        self.last_row: tuple | None = None
        self._insert()

    def add(self, turn: int | None, role: str, text: str, first_turn, long: bool) -> None:
        """Take in the next row. Of a long conversation's repeats ``first_turn`` is that of the
        first such row."""
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.last_initial is not None:
            self.illegal += self.last_initial + role[:1] not in ("su", "ua", "au")
        self.last_initial = role[:1]
        if long:
            repeated = (turn, role, text) == self.last_row or (first_turn is not None and first_turn != (turn,))
            self.last_row = (turn, role, text)
        else:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            repeated = key in self.seen
            self.seen.add(key)
        bare = text.rstrip(WHITE)
        must_go, cut = not bare or repeated, bare[-1:] not in ENDS
        if not bare:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self._row(role[:1], must_go, not must_go and cut)
        self.open_rows.append((role, text))
        self.open_bytes += len(role) + len(text)
        if self.made > self.node_room or self.open_bytes > self.byte_room:
            self._settle()

    def _best(self, ways: list[tuple[int, Edit, str]]) -> tuple[int, Edit]:
        """The cheapest of (cost, edits before, letter), the least edits among equals."""
        least = min(way[0] for way in ways)
        found = None
        for cost, before, letter in ways:
            if cost == least:
                edit = Edit(before, letter) if letter else before
                self.made += bool(letter)
                if found is None or sorts_before(edit, found):
                    found = edit
        return least, found

    def _row(self, initial: str, must_go: bool, cut: bool) -> None:
        old = self.states
        ways = {state: [(cost + DELETE_COST, edit, "D")] for state, (cost, edit) in old.items()}
        if not must_go:
            kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
            for target in (USER, ASSISTANT):
                letter, extra = ("K", cut) if target == kept else ("R", cut + RELABEL_COST)
                for state in BEFORE[target]:
                    if state in old:
                        ways.setdefault(target, []).append((old[state][0] + extra, old[state][1], letter))
            if kept == SYSTEM and NOTHING in old:
                ways.setdefault(SYSTEM, []).append((old[NOTHING][0] + cut, old[NOTHING][1], "K"))
        self.states = {state: self._best(found) for state, found in ways.items()}
        self._insert()

    def _insert(self) -> None:
        """Turns inserted behind the row; more than a user and an assistant are never cheaper."""
        for target in (USER, ASSISTANT):
            ways = [(*self.states[target], "")] if target in self.states else []
            for state in BEFORE[target]:
                if state in self.states:
                    cost, edit = self.states[state]
                    ways.append((cost + INSERT_COST, edit, "I"))
            self.states[target] = self._best(ways)

    def _settle(self) -> None:
        """Apply the edits that all states share and let go of what lies before them."""
        nodes = [edit for _, edit in self.states.values()]
        common = nodes[0]
        for edit in nodes[1:]:
            common = shared(common, edit)
        self._apply(letters(common, self.root))
        root = Edit(None, "", common.depth, common.code)
        copies = {id(common): root}
        for edit in nodes:
            chain = []
            while id(edit) not in copies:
                chain.append(edit)
                edit = edit.parent
            for old in reversed(chain):
                copies[id(old)] = Edit(copies[id(old.parent)], old.letter)
        self.states = {s: (cost, copies[id(edit)]) for s, (cost, edit) in self.states.items()}
        self.root, self.made = root, len(copies)
        self.node_room = max(OPEN_NODES, 2 * self.made)
        self.byte_room = max(OPEN_BYTES, 2 * self.open_bytes)

    def _apply(self, edits: str) -> None:
        self.audit.append(edits)
        taken = 0
        for letter in edits:
            role = text = ""
            if letter != "I":
                role, text = self.open_rows[taken]
                taken += 1
            if letter == "D":
                continue
            if letter == "K":
                self.last = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            else:
                self.last = ASSISTANT if self.last == USER else USER
                role = NAMES[self.last]
            line = f"{role}:{text}"
            self.hash.update((f"\n{line}" if self.wrote else line).encode())
            self.wrote = True
        for role, text in self.open_rows[:taken]:
            self.open_bytes -= len(role) + len(text)
        del self.open_rows[:taken]

    def result(self) -> dict:
        ends = [(*self.states[s], "") for s in (NOTHING, ASSISTANT) if s in self.states]
        cost, edit = self._best(ends)
        self._apply(letters(edit, self.root))
        return {
            "conv_id": self.conv_id,
            "gaps": 0 if self.most is None else self.most - self.least + 1 - self.turns,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": cost,
            "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = pa.schema(
    [("conv_id", pa.int64()), *((name, pa.int64()) for name in COUNTS),
     ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
RESULT_DDL = (
    "conv_id bigint, " + ", ".join(f"{name} bigint" for name in COUNTS) + ", audit string, repaired_sha256 string"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn in, one row per conversation out."""
    current: Repair | None = None
    done: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != current.conv_id:
                if current is not None:
                    done.append(current.result())
                current = Repair(row["conv_id"])
            first = None if row["first_turn"] is None else (row["first_turn"]["turn"],)
            for _ in range(row["copies"]):
                current.add(row["turn"], row["role"], row["text"], first, row["long"])
        if done:
            yield pa.RecordBatch.from_pylist(done, RESULT)
            done = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.result()], RESULT)


def spaced(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def given(conversations: DataFrame) -> DataFrame:
    """The rows as they are: conv_id, turn, role, text, copies (one each)."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        spaced(F.col("role")).alias("role"),
        spaced(F.col("text")).alias("text"),
        F.lit(1).alias("copies"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``given`` rows of which some are dropped (no copies), emptied, robbed of their sentence
    ends, repeated (two copies) or given to the user, by the checksum of conversation and turn."""
    rows = given(conversations)
    fate = F.crc32(F.concat_ws(":", spaced(F.col("conv_id")), spaced(F.col("turn")))) % 20
    return rows.withColumn("fate", fate).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "")
        .when(F.col("fate") == 2, F.translate("text", ENDS, ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row per conversation of ``given`` or ``damaged`` rows: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    short_batches(spark)
    none = F.lit(None).cast("struct<turn: bigint>")
    counted = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"))
    long = stage(counted.filter(F.col("n") > long_rows).select("conv_id"), "long-conversations")
    if long.isEmpty():
        marked = rows.select("*", F.lit(False).alias("long"), none.alias("first_turn"))
    else:
        # found once per text that comes again; equal rows of one turn stand together anyway
        long = bounded_broadcast(long.select(F.col("conv_id").alias("_conv"), F.lit(True).alias("long")))
        whose = F.col("conv_id").eqNullSafe(F.col("_conv"))
        digest = F.sha2("text", 256).alias("digest")
        marked = rows.join(long, whose, "left").drop("_conv")
        marked = marked.withColumn("long", F.coalesce("long", F.lit(False)))
        order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        firsts = (
            marked.filter("long and copies > 0")
            .groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), digest.alias("_digest"))
            .agg(F.min(order).alias("order"), F.count("*").alias("n"))
            .filter("n > 1")
            .select("_conv", "_role", "_digest", F.struct("order.turn").alias("first_turn"))
        )
        met = whose & (F.col("role") == F.col("_role")) & (digest == F.col("_digest")) & F.col("long")
        marked = marked.join(stage(firsts, "first-turns"), met, "left").drop("_conv", "_role", "_digest")
    dealt = marked.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    )
    return dealt.select(
        "conv_id", "turn", "role", "text", "copies", "long", "first_turn"
    ).mapInArrow(_walk, RESULT_DDL)
