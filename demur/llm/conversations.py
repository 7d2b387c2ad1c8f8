"""Repair of the role structure of conversations, with an audit of the edits.

Legal role initials are ``(s?(ua)+)?``. A dynamic program over a conversation's messages keeps,
per state of that grammar, the cheapest edits so far: Keep (0), Rerole to user or assistant
(2), Delete (3), Insert an empty message (2); a message that is cut off costs 1 unless deleted.
Blank messages and repeats must be deleted. Equal costs are decided for the audit (the edits'
initials) that is least in ASCII order.

The audits are *persistent*: an edit is a node linked to the one before, so all states share
their prefixes. A node also has its ancestors at distances 1, 2, 4, ... and a rolling hash of
its whole string. Two audits of equal cost are compared by finding their longest common prefix
with jumps over equal hashes, then by the edit after it. Equal hashes of different nodes are
verified edit by edit, so a collision changes nothing.

At one message and state, no audit of the least cost is a proper prefix of another one (what
is longer would have more paid inserts), so the least prefix stays the least whatever follows.

Conversations are streams: Spark deals them out by id and sorts them, and a task reads one
message after the other. It holds the nodes since the point up to which all states agree -
what lies before is written out at once - and per state the checksum of the repaired text,
which is forked where states part. States that can no longer win are dropped, so that the
others soon agree. No conversation is collected; a checksum over it is one task's work by nature.

Messages are ordered by turn (nulls first), then role and text; null roles and texts are one
space. Roles are told by their first letter; a message whose role has none of s, u, a can't be
kept. Null ids are one conversation. Repeated rows are repeats like any other. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur.llm.common import release_memory, small_batches

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_OFF = 1
#: nodes after which what all states agree on is written out
NODES = 20_000
MODULUS, BASE = (1 << 61) - 1, 911_382_323

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, REPEAT, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: where a message with this initial may be kept: from these states, to that one
KEPT = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
TO_USER, TO_ASSISTANT = (EMPTY, SYSTEM, ASSISTANT), (USER,)
LEGAL_PAIRS = {"su", "ua", "au"}

AUDIT_SCHEMA = """conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,
    audit string, repaired_sha256 string"""


class Edits:
    """Strings of edits as linked nodes. Node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.parents, self.letters, self.depths, self.hashes = [0], [""], [0], [0]
        self.jumps: list[list[int]] = [[]]

    def __len__(self) -> int:
        return len(self.parents)

    def grow(self, node: int, letter: str) -> int:
        new = len(self.parents)
        self.parents.append(node)
        self.letters.append(letter)
        self.depths.append(self.depths[node] + 1)
        self.hashes.append((self.hashes[node] * BASE + ord(letter)) % self.modulus)
        far, k, jumps = node, 0, self.jumps
        own = [far]
        while k < len(jumps[far]):
            far = jumps[far][k]
            own.append(far)
            k += 1
        jumps.append(own)
        return new

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor that is the prefix of this length."""
        rest = self.depths[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.jumps[node][k]
            rest -= 1 << k
        return node

    def less(self, x: int, y: int) -> bool:
        """Is x's string before y's? A proper prefix comes first."""
        if x == y:
            return False
        depth = min(self.depths[x], self.depths[y])
        a, b = self.lifted(x, depth), self.lifted(y, depth)
        if self.hashes[a] == self.hashes[b]:
            if a == b or self.text(a) == self.text(b):
                return self.depths[x] < self.depths[y]
            return self.text(x) < self.text(y)
        while True:  # the strings differ: go back as far as they still do
            for k in range(len(self.jumps[a]) - 1, -1, -1):
                if self.hashes[self.jumps[a][k]] != self.hashes[self.jumps[b][k]]:
                    a, b = self.jumps[a][k], self.jumps[b][k]
                    break
            else:
                break
        before, other = self.parents[a], self.parents[b]
        if before != other and self.text(before) != self.text(other):
            return self.text(x) < self.text(y)
        return self.letters[a] < self.letters[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.parents[node]
        return "".join(reversed(out))

    def agreed(self, live: list[int]) -> tuple[str, list[int]]:
        """Cut off what the live strings have in common: that string, and the nodes of the rest."""
        chains = []
        for node in live:
            chain = [node]
            while node:
                node = self.parents[node]
                chain.append(node)
            chains.append(chain)
        shared = set(chains[0]).intersection(*chains[1:])
        root = max(shared)
        common = self.text(root)
        rest = sorted(set().union(*chains) - shared)  # parents have smaller numbers
        letters, parents = [self.letters[n] for n in rest], [self.parents[n] for n in rest]
        self.__init__(self.modulus)
        new = {root: 0}
        for node, letter, parent in zip(rest, letters, parents, strict=True):
            new[node] = self.grow(new[parent], letter)
        return common, [new[n] for n in live]


class Repair:
    """One conversation, message by message, in order."""

    def __init__(self, modulus: int = MODULUS, nodes: int = NODES):
        self.edits = Edits(modulus)
        self.nodes = self.limit = nodes
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.turns: list[int] | None = None  # smallest, last, number of different ones
        self.initial: str | None = None
        self.written: list[str] = []
        #: per state: cost, node, checksum of the repaired text
        self.states: list[tuple[int, int, object] | None] = [(0, 0, hashlib.sha256()), None, None, None]
        self._insert(self.states)

    def _better(self, states, to: int, cost: int, come: tuple, letter: str, line: bytes | None, start: bool) -> None:
        """Take this edit if it is the best one to the state so far."""
        held = states[to]
        if held is not None and held[0] < cost:
            return
        node = self.edits.grow(come[1], letter)
        if held is not None and held[0] == cost and not self.edits.less(node, held[1]):
            return
        digest = come[2]
        if line is not None:
            digest = digest.copy()
            digest.update(line if start else b"\n" + line)
        states[to] = (cost, node, digest)

    def _insert(self, states) -> None:
        for sources, to, line in ((TO_USER, USER, b"user:"), (TO_ASSISTANT, ASSISTANT, b"assistant:")):
            for s in sources:
                if (come := states[s]) is not None:
                    self._better(states, to, come[0] + INSERT, come, "I", line, s == EMPTY)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        before = self.states
        states: list = [None, None, None, None]
        for s, come in enumerate(before):
            if come is not None:
                self._better(states, s, come[0] + DELETE, come, "D", None, False)
        if fault in (FINE, TRUNCATED):
            extra = CUT_OFF if fault == TRUNCATED else 0
            if initial in KEPT:
                sources, to = KEPT[initial]
                line = f"{role}:{text}".encode()
                for s in sources:
                    if (come := before[s]) is not None:
                        self._better(states, to, come[0] + KEEP + extra, come, "K", line, s == EMPTY)
            for sources, to in ((TO_USER, USER), (TO_ASSISTANT, ASSISTANT)):
                line = f"{ROLES[to]}:{text}".encode()
                for s in sources:
                    if (come := before[s]) is not None:
                        self._better(states, to, come[0] + REROLE + extra, come, "R", line, s == EMPTY)
        self._insert(states)
        # whatever may follow, these lose against the state after an assistant
        bound = states[ASSISTANT][0]
        if states[EMPTY] is not None and states[EMPTY][0] > bound + DELETE:
            states[EMPTY] = None
        if states[SYSTEM] is not None and states[SYSTEM][0] > bound:
            states[SYSTEM] = None
        self.states = states
        if len(self.edits) > self.limit:
            self._write_out()

    def _write_out(self) -> None:
        live = [s for s in range(4) if self.states[s] is not None]
        common, nodes = self.edits.agreed([self.states[s][1] for s in live])
        self.written.append(common)
        for s, node in zip(live, nodes, strict=True):
            self.states[s] = (self.states[s][0], node, self.states[s][2])
        self.limit = max(self.nodes, 2 * len(self.edits))

    def result(self) -> dict:
        ends = [self.states[s] for s in (EMPTY, ASSISTANT) if self.states[s] is not None]
        best = ends[0]
        if len(ends) == 2 and (ends[1][0] < best[0] or ends[1][0] == best[0] and self.edits.less(ends[1][1], best[1])):
            best = ends[1]
        first, last, different = self.turns or (0, -1, 0)
        return {
            "gaps": last - first + 1 - different, "blank": self.counts[BLANK], "duplicate": self.counts[REPEAT],
            "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": best[0],
            "audit": "".join(self.written) + self.edits.text(best[1]), "repaired_sha256": best[2].hexdigest(),
        }


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by checksum of conversation and turn; dropped messages stay as rows with ``present`` false."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame, present: Column | None) -> DataFrame:
    """Messages with their first fault, dealt out by conversation and sorted. One exchange.

    A conversation's messages stay on the task that its id is dealt to, sorted on disk where
    memory doesn't hold them; the window only looks at the message before.
    """
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"),
    )
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    seen = plain.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    shown = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(shown == "", BLANK).when(F.col("seen"), REPEAT)
        .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("fault")
    )
    return seen.select("conv_id", "turn", "role", "text", "present", fault).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"
    )


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, repair, out = None, None, []
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    types = [pa.int64()] * 6 + [pa.string()] * 2
    kind = None

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([c for c, _ in out], kind), *(pa.array([r[n] for _, r in out], t) for n, t in zip(names, types, strict=True))]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *names])

    for batch in small_batches(batches):
        kind = batch.column("conv_id").type
        for conv, turn, role, text, present, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "fault"))):  # noqa: B905
            if repair is None or conv != current:
                if repair is not None:
                    out.append((current, repair.result()))
                    if len(out) >= 1000:
                        yield flush()
                current, repair = conv, Repair()
            if present:
                repair.add(turn, role, text, fault)
    if repair is not None:
        out.append((current, repair.result()))
        yield flush()
    release_memory()


def audit_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: faults, the cheapest edits and the checksum of the repaired text.

    Messages that are not ``present`` count only as a sign that the conversation exists.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, present).mapInArrow(_audits, AUDIT_SCHEMA.format(id=kind))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages after the edits. Each conversation's audit comes before its messages."""
    audit, at, place, state = "", 0, 0, EMPTY
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = USER if state in TO_USER else ASSISTANT
            out.append((conv, place, ROLES[state], "", "I"))
            at, place = at + 1, place + 1

    for batch in small_batches(batches):
        for row in batch.to_pylist():
            conv = row["conv_id"]
            if row["audit"] is not None:
                audit, at, place, state = row["audit"], 0, 0, EMPTY
                inserts()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                state = KEPT[row["role"][:1]][1] if edit == "K" else USER if state in TO_USER else ASSISTANT
                out.append((conv, place, row["role"] if edit == "K" else ROLES[state], row["text"], edit))
                place += 1
            inserts()
        columns = list(zip(*out)) if out else [[]] * 5  # noqa: B905
        types = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "turn", "role", "text", "edit"]
        )
        out.clear()
    release_memory()


def repair_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired messages: ``conv_id, turn`` (from 0), ``role, text, edit``, by replaying the audits."""
    messages = _in_order(rows, present).filter("present").drop("present", "fault").withColumn("audit", F.lit(None).cast("string"))
    audits = audit_conversations(rows, present).select("conv_id", "audit")
    both = messages.unionByName(audits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text"
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.mapInArrow(_applied, f"conv_id {kind}, turn long, role string, text string, edit string")
