"""Conversation structure repair by a Viterbi search that emits edits as soon as they are certain.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Every row is kept, given another role or deleted, and
empty turns may be put in; the cheapest edits win, and among them the ASCII-least string of their initials.

The search has four states (nothing yet, after a system row, after a user row, after an assistant row), so at most four
survivors. Their histories are a tree of back pointers with reference counts. A node that only one branch refers to is
merged into that branch; when only one branch is left at the root, its edits are the same for every survivor and
are emitted, and their rows are released. A state that can do nothing another one cannot do strictly cheaper is dropped,
which lets the survivors meet. Children of a node differ in their symbol, so two tied histories are compared over their whole
unresolved parts by the symbols at their last common node.

Rows are dealt by conversation and sorted by Spark inside the task, then streamed. A task holds the unresolved rows of one
conversation only. Which rows are repeats is decided before, by counts over (conversation, role, text digest) that are combined before
their shuffle: no task remembers the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# Next state by state and initial. 0: nothing yet, 1: after s, 2: after u, 3: after a (may end, as 0).
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
# SPARE[q][p]: what state q pays at most to do whatever state p does from here on.
# From a: a later s is deleted; from u: an assistant is put in. An opening (0, 1) can put in what it lacks.
SPARE = ((0, 0, INSERT, 0), (2 * INSERT, 0, INSERT, 2 * INSERT), (INSERT + DELETE, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))
LEGAL_PAIRS = ("su", "ua", "au")
_LARGEST = (1 << 63) - 1


class Node:
    """A branching of the back-pointer tree: the edits since its parent, and how many branches and survivors refer to it."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Node | None = None, edits: bytes = b""):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 1
        if parent:
            parent.refs += 1

    def release(self) -> None:
        """One reference less; a branch that nothing refers to any more goes."""
        self.refs -= 1
        if not self.refs and self.parent:
            self.parent.release()


def comes_first(a: Node, x: bytes, b: Node, y: bytes) -> bool:
    """Is history a with edit x before history b with edit y in ASCII order?

    Children of a node differ in their first symbol, so the symbols that follow the last common node decide.
    """
    after, node, following = {}, a, x
    while node:
        after[node], following, node = following, bytes(node.edits[:1]), node.parent
    node, following = b, y
    while node not in after:
        following, node = bytes(node.edits[:1]), node.parent
    return after[node] < following


class Search:
    """The survivors of one conversation, by state: (cost, node). ``emitted`` takes the edits that have become certain."""

    def __init__(self):
        self.root = Node()
        self.alive = {0: (0, self.root)}
        self.emitted = bytearray()
        self._insert()

    def _choose(self, options: list[tuple[int, int, Node, bytes]]) -> None:
        """The cheapest, then ASCII-least, history of every state; states that another one beats whatever follows are dropped."""
        best: dict[int, tuple[int, Node, bytes]] = {}
        for state, cost, node, edit in options:
            old = best.get(state)
            if old is None or cost < old[0] or (cost == old[0] and comes_first(node, edit, old[1], old[2])):
                best[state] = (cost, node, edit)
        before, self.alive = self.alive, {}
        for state, (cost, node, edit) in best.items():
            if any(best[q][0] + SPARE[q][state] < cost for q in best):
                continue
            if edit:
                node = Node(node, edit)
            else:
                node.refs += 1
            self.alive[state] = (cost, node)
        for _, node in before.values():
            node.release()
        self._shorten()

    def _insert(self) -> None:
        """Turns put in ahead of the next row: one user, or assistant, or both."""
        for target, sources in ((2, (0, 1, 3)), (3, (2,))):
            put = [(target, self.alive[s][0] + INSERT, self.alive[s][1], b"I") for s in sources if s in self.alive]
            self._choose([(s, c, n, b"") for s, (c, n) in self.alive.items()] + put)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        options = []
        for state, (cost, node) in self.alive.items():
            options.append((state, cost + DELETE, node, b"D"))
            for wanted, to in () if must_go else NEXT[state].items():
                if wanted == initial:
                    options.append((to, cost + TRUNCATED * truncated, node, b"K"))
                elif wanted in ROLES:
                    options.append((to, cost + REROLE + TRUNCATED * truncated, node, b"R"))
        self._choose(options)
        self._insert()

    def _shorten(self) -> None:
        """Merge nodes that one branch alone refers to; at the root, emit what all survivors share."""
        for _, node in self.alive.values():
            while node.parent:
                up = node.parent
                if up.parent and up.refs == 1:
                    up.edits += node.edits
                    node.edits, node.parent = up.edits, up.parent
                else:
                    node = up
        if self.root.refs == 1 and not any(n is self.root for _, n in self.alive.values()):
            child = next(iter(self.alive.values()))[1]
            while child.parent is not self.root:
                child = child.parent
            self.emitted += child.edits
            child.parent, self.root = None, child
            self.root.edits = bytearray()

    def finish(self) -> None:
        """The last row has been given: keep the best history that may end here. All edits are in ``emitted`` then."""
        ends = [(0, *self.alive[s], b"") for s in ENDS if s in self.alive]
        self._choose(ends)


def put_in_role(state: int) -> str:
    """The role that an edit gives a turn after this state; there is one only."""
    return ROLES["a" if state == 2 else "u"]


def fault_of(text: str, repeated: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    said = text.strip(" \t\n\x0b\x0c\r")
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if said[-1] in ".!?" else "truncated"


class Repair:
    """Feeds rows to the search and pairs certain edits with their rows; holds the rows without a certain edit."""

    def __init__(self, conv_id):
        self.conv_id, self.search, self.rows, self.state, self.n = conv_id, Search(), deque(), 0, 0

    def add(self, turn, role: str, text: str, repeated: bool) -> list[tuple]:
        fault = fault_of(text, repeated)
        self.rows.append((turn, role, text, fault))
        self.search.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        return self._certain()

    def end(self) -> list[tuple]:
        self.search.finish()
        rest = self._certain()
        return rest if self.n else [(self.conv_id, 0, None, None, None, None, None, None, 0)]

    def _certain(self) -> list[tuple]:
        out = []
        for edit in self.search.emitted.decode("ascii"):
            self.n += 1
            if edit == "I":
                turn, was, text, fault, role, cost = None, None, "", None, put_in_role(self.state), INSERT
            else:
                turn, was, text, fault = self.rows.popleft()
                role = put_in_role(self.state) if edit == "R" else was
                cost = {"K": 0, "R": REROLE, "D": DELETE}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
            if edit != "D":
                self.state = NEXT[self.state][role[:1]]
            out.append((self.conv_id, self.n, edit, turn, role, text, was, fault, cost))
        self.search.emitted.clear()
        return out


EDITS = "conv_id long, n long, edit string, turn long, role string, text string, was_role string, fault string, cost long"


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with known damage by a hash of (conversation, turn), to repair again; rows with ``gone`` have been dropped."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("hit", F.crc32(name.cast("binary")) % 20)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def in_order(turns: DataFrame, gone: Column) -> DataFrame:
    """Rows of a conversation in one task and in order, with ``repeated``: said more than once, and not first in this turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        gone.alias("gone"),
    )
    rows = rows.select(
        "conv_id", "turn", "gone", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("role", "text")],
        F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.char_length("role"), "role", "text"), 256).alias("said"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn").alias("turn"))
    first = rows.where("NOT gone").groupBy("said").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    first = first.where("times > 1").drop("times")
    joined = rows.join(first, "said", "left")
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    return (
        joined.select("conv_id", "turn", "role", "text", "gone", later.alias("repeated"))
        .repartition("conv_id")
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    )


def repair_turns(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """The edits of every conversation in order, one row each; those of a conversation lie together in one task.

    ``edit`` is K, R, D or I; role and text are those after the edit (of a deleted row its own); ``was_role`` and ``fault`` say what
    the row was, NULL for turns put in. Rows with ``gone`` only name their conversation; one without rows gives a single row whose edit is NULL.

    NULL role or text: one space. NULL turn: first. NULL conv_id: one conversation of its own. Rows of one turn are taken by role
    and text; repeated rows are faults. An empty role fits nowhere and is given another role or deleted. An empty table gives an empty
    result. Other columns are ignored.
    """
    names = [x.split()[0] for x in EDITS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in EDITS.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        repair, last = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if repair is None or row["conv_id"] != repair.conv_id:
                    if repair:
                        out += repair.end()
                    repair, last = Repair(row["conv_id"]), None
                if row["gone"]:
                    continue
                this = (row["turn"], row["role"], row["text"])
                out += repair.add(*this, row["repeated"] or this == last)
                last = this
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        if repair:
            yield batch_of(repair.end())

    return in_order(turns, F.lit(False) if gone is None else gone).mapInArrow(run, EDITS)


AUDIT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def audits(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair_turns`` as they lie: faults, cost, edits and a digest of what is left.

    ``gaps`` beyond a long are held at the largest long. The digest is a running hash; the string of edits is the only thing that grows with
    a conversation.
    """
    names = [x.split()[0] for x in AUDIT.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in AUDIT.split(", ")]

    def run(batches):
        at, state, done = object(), None, []

        def flush():
            columns = list(zip(*done)) or [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def close():
            least, most, distinct = state["turns"]
            gaps = min(most - least + 1 - distinct, _LARGEST) if distinct else 0
            faults = [state["faults"].get(f, 0) for f in ("blank", "duplicate", "truncated")]
            done.append((at, gaps, *faults, state["illegal"], state["cost"], state["audit"].decode("ascii"), state["hash"].hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != at:
                    if state:
                        close()
                    at = row["conv_id"]
                    state = dict(turns=(None, None, 0), faults={}, illegal=0, cost=0, audit=bytearray(), hash=hashlib.sha256(), role=None, kept=0)
                if row["edit"] is None:
                    continue
                state["audit"] += row["edit"].encode()
                state["cost"] += row["cost"]
                if row["edit"] != "I":
                    state["faults"][row["fault"]] = state["faults"].get(row["fault"], 0) + 1
                    initial = row["was_role"][:1]
                    if state["role"] is not None and state["role"] + initial not in LEGAL_PAIRS:
                        state["illegal"] += 1
                    state["role"] = initial
                    least, most, distinct = state["turns"]
                    turn = row["turn"]
                    if turn is not None and turn != most:
                        state["turns"] = (turn if least is None else least, turn, distinct + 1)
                if row["edit"] != "D":
                    said = "\n" * (state["kept"] > 0) + f"{row['role']}:{row['text']}"
                    state["hash"].update(said.encode("utf-8", "surrogatepass"))
                    state["kept"] += 1
            if len(done) > 5000:
                yield flush()
        if state:
            close()
        yield flush()

    return edits.mapInArrow(run, AUDIT)
