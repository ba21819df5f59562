"""Structure repair of conversations: cheapest edits that make the roles alternate.

Rows of a conversation are kept, given another role, deleted, and empty turns inserted, so that the initials of the roles read
``(s?(ua)+)?``. The edits form a lattice: a node is a number of rows read and one of four states of that pattern, an edge is
an edit. Keep costs 0, Rerole 2, Delete 3 (the only edit of a blank or duplicate row), Insert 2; a truncated row that is not
deleted adds 1. From both ends of the lattice a Dijkstra search goes forward and in reverse, each with a heap; when the
heaps' tops together cost more than the cheapest meeting, all crossings of that cost are closed, and the
crossing with the least concatenated audit (initials of the edits in order) wins. A pattern state and an edit decide the
next state, and equally cheap audits of a node are never prefixes of each other, so least parts make the least whole.

How it is spread: rows are range-partitioned and sorted by (conversation, turn, role, text) and streamed. A conversation that lies
inside a partition and has at most ``SEGMENT`` rows is finished there. The rest, at most two conversations at the borders of
a partition and longer ones, go in segments of at most ``SEGMENT`` rows, each searched between all pairs of states; a
grouped fold over the segments, which hold no texts, gives their audit. So a conversation with a third of all rows is dealt out like any other. Only its
digest runs through one task, since a hash is sequential by definition: the rows are streamed in order, none is kept.
A row is a duplicate if its role and text stand at an earlier turn (a grouped minimum over 128-bit hashes, joined back for the few messages that
stand at several turns) or right before it in the order.

Edge cases: null roles and texts are one space, so such a text is blank and such a role is never kept; null turns come first; rows with equal
turns are ordered by role and text; repeated rows are duplicates; a null conv_id is a conversation of its own; an
empty role, which has no initial, is never kept either; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferret.llm.common import stage

SEGMENT, BATCH = 512, 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# states of the pattern: nothing yet, after s, after u, after a; the letter that may follow and where it leads
START, SYSTEM, USER, ASSISTANT = range(4)
LETTER, NEXT = "uuau", (USER, USER, ASSISTANT, USER)
BEFORE = tuple(tuple(p for p in range(4) if NEXT[p] == s) for s in range(4))
ACCEPT = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_INK = re.compile("[^\x20\x09-\x0d]")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- the lattice

def search(rows: list[tuple[str, bool, bool]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from state ``entry`` to one of ``exits``. Rows are (initial, must go, truncated)."""
    n = len(rows)
    ahead, behind = {(0, entry): (0, "")}, {(n, x): (0, "") for x in exits}
    front, rear = [(0, 0, entry)], [(0, -n, x) for x in exits]
    heapq.heapify(rear)
    best = 0 if (0, entry) in behind else 1 << 62

    def relax(labels, others, heap, node, cost, audit, key):
        nonlocal best
        old = labels.get(node)
        if old is None or cost < old[0]:
            labels[node] = cost, audit
            heapq.heappush(heap, key)
            if node in others:
                best = min(best, cost + others[node][0])
        elif cost == old[0] and audit < old[1]:
            labels[node] = cost, audit

    while front and rear and front[0][0] + rear[0][0] <= best:
        if front[0][0] <= rear[0][0]:
            cost, i, s = heapq.heappop(front)
            c, audit = ahead[i, s]
            if c < cost:
                continue
            steps = [(INSERT, "I", i, NEXT[s])]
            if i < n:
                letter, gone, cut = rows[i]
                steps.append((DELETE, "D", i + 1, s))
                if not gone:
                    if letter == LETTER[s]:
                        steps.append((KEEP + cut * TRUNCATED, "K", i + 1, NEXT[s]))
                    elif letter == "s" and s == START:
                        steps.append((KEEP + cut * TRUNCATED, "K", i + 1, SYSTEM))
                    if letter != LETTER[s]:
                        steps.append((REROLE + cut * TRUNCATED, "R", i + 1, NEXT[s]))
            for w, edit, j, t in steps:
                relax(ahead, behind, front, (j, t), cost + w, audit + edit, (cost + w, j, t))
        else:
            cost, i, s = heapq.heappop(rear)
            i = -i
            c, audit = behind[i, s]
            if c < cost:
                continue
            steps = [(INSERT, "I", i, p) for p in BEFORE[s]]
            if i:
                letter, gone, cut = rows[i - 1]
                steps.append((DELETE, "D", i - 1, s))
                if not gone:
                    for p in BEFORE[s]:
                        if letter == LETTER[p]:
                            steps.append((KEEP + cut * TRUNCATED, "K", i - 1, p))
                        else:
                            steps.append((REROLE + cut * TRUNCATED, "R", i - 1, p))
                    if s == SYSTEM and letter == "s":
                        steps.append((KEEP + cut * TRUNCATED, "K", i - 1, START))
            for w, edit, j, t in steps:
                relax(behind, ahead, rear, (j, t), cost + w, edit + audit, (cost + w, -j, t))
    if best == 1 << 62:
        return None
    return best, min(a + behind[v][1] for v, (c, a) in ahead.items() if v in behind and c + behind[v][0] == best)


def join_segments(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cheapest cost and least audit through consecutive segments, each a list of (entry, exit, cost, audit)."""
    now = {START: (0, "")}
    for edges in parts:
        then: dict[int, tuple[int, str]] = {}
        for a, b, cost, audit in edges:
            if a in now:
                c = now[a][0] + cost
                if b not in then or c <= then[b][0]:
                    label = c, now[a][1] + audit
                    if b not in then or label < then[b]:
                        then[b] = label
        now = then
    return min(now[s] for s in ACCEPT if s in now)


class Replay:
    """Applies an audit to rows as they come and hashes the repaired ``role:text`` lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.some = audit, 0, START, hashlib.sha256(), False

    def _line(self, role: str, text: str):
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def _inserts(self):
        while self.audit[self.at:self.at + 1] == "I":
            self._line(ROLE[LETTER[self.state]], "")
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, role: str, text: str):
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and self.state == START and role[:1] == "s":
            self._line(role, text)
            self.state = SYSTEM
            return
        self._line(role if edit == "K" else ROLE[LETTER[self.state]], text)
        self.state = NEXT[self.state]

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


# ---------------------------------------------------------------- one conversation

class Run:
    """Rows of one conversation as they come in order."""

    def __init__(self, conv, last=None):
        self.conv, self.last = conv, last  # last: (turn, role, text) of the row before, to tell repeated rows
        self.rows, self.lines = [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first = self.end = ""

    def add(self, turn, role: str, text: str, seen: bool):
        ink = _INK.findall(text[-256:]) or _INK.findall(text)
        blank = not ink
        duplicate = not blank and (seen or self.last == (turn, role, text))
        truncated = not blank and not duplicate and ink[-1] not in ".!?"
        self.last = turn, role, text
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows:
            self.illegal += self.end + role[:1] not in LEGAL
        else:
            self.first = role[:1]
        self.end = role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.rows.append((role[:1], blank or duplicate, truncated))
        self.lines.append((role, text))

    def result(self):
        cost, audit = search(self.rows, START, ACCEPT)
        replay = Replay(audit)
        for line in self.lines:
            replay.row(*line)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, replay.digest()

    def edges(self):
        return [(a, b, *found) for a in range(4) for b in range(4) if (found := search(self.rows, a, (b,)))]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = ("part int, seq int, n long, first_turn long, last_turn long, turns long, first string, last string, "
         "edges array<struct<a: int, b: int, cost: long, audit: string>>")


def _streamed(batches):
    """(conv, turn, role, text, copies, seen) of all rows in order."""
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in b.slice(i, BATCH).columns))


def _scan(kind: pa.DataType, names: list[str], types: list[pa.DataType]):
    """Finished conversations (part null) and segments of the others, a batch at a time."""
    def run(batches):
        part, out, seq, whole = TaskContext.get().partitionId(), [], 0, True
        cur, opened = None, True  # opened: the current run may have begun in an earlier partition

        def flush(borders: bool):
            nonlocal seq
            if borders:  # this conversation goes in segments; the digest holds if it turns out to be the only one
                digest = None if not whole else cur.result()[-1] if cur.rows else EMPTY_SHA
                out.append((cur.conv, None, cur.blank, cur.duplicate, cur.truncated, cur.illegal, None, None, digest,
                            part, seq, len(cur.rows), cur.first_turn, cur.last_turn, cur.turns, cur.first, cur.end,
                            [dict(zip(("a", "b", "cost", "audit"), e)) for e in cur.edges()]))
                seq += 1
            else:
                out.append((cur.conv, *(cur.result() if cur.rows else (0, 0, 0, 0, 0, 0, "", EMPTY_SHA)), *[None] * 9))

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, *types])], names=["conv_id", *names])
            out.clear()
            return done

        for conv, turn, role, text, copies, seen in _streamed(batches):
            if cur is None or conv != cur.conv:
                if cur is not None:
                    flush(opened)
                    opened = False
                    if len(out) >= BATCH:
                        yield batch()
                cur, seq, whole = Run(conv), 0, True
            for _ in range(copies):
                if len(cur.rows) == SEGMENT:
                    whole = False
                    flush(True)
                    opened = True
                    cur = Run(conv, cur.last)
                    if len(out) >= BATCH // 8:
                        yield batch()
                cur.add(turn, role, text, seen)
        if cur is not None:
            flush(True)
        if out:
            yield batch()
    return run


def _join(kind: pa.DataType):
    """Result row of one conversation from its segments."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        full = [r for r in rows if r["n"]]
        counts = {c: sum(r[c] for r in full) for c in ("blank", "duplicate", "truncated", "illegal")}
        turns, low, high, end = 0, None, None, None
        for r in full:
            counts["illegal"] += end is not None and end + r["first"] not in LEGAL
            end = r["last"]
            if r["turns"]:
                turns += r["turns"] - (high == r["first_turn"])
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
        cost, audit = join_segments([[(e["a"], e["b"], e["cost"], e["audit"]) for e in r["edges"]] for r in full])
        alone = EMPTY_SHA if not full else full[0]["repaired_sha256"] if len(full) == 1 else None
        values = [high - low + 1 - turns if turns else 0, *counts.values(), cost]
        return pa.table([pa.array([rows[0]["conv_id"]], kind), *[pa.array([v], pa.int64()) for v in values], pa.array([audit], pa.string()), pa.array([alone], pa.string())],
                        names=["conv_id", *[c.split()[0] for c in RESULT.split(", ")]])
    return run


def _digests(names: list[str], kind: pa.DataType):
    def run(batches):
        out, cur, replay = [], None, None
        for conv, turn, role, text, copies, head in _streamed(batches):
            if head:
                if replay is not None:
                    out.append((cur, replay.digest()))
                cur, replay = conv, Replay(text)
            else:
                for _ in range(copies):
                    replay.row(role, text)
        if replay is not None:
            out.append((cur, replay.digest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, pa.string()])], names=names)
    return run


# ---------------------------------------------------------------- the operator

def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults by crc32(``conv_id:turn``) modulo 20; ``copies`` says how often a row stands (0: it is dropped)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(word("role")).alias("role"),
                                text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("int").alias("copies"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Repair ``rows`` (conv_id, turn, role, text, optionally copies: how often a row stands, 0 for a conversation's mere mention).
    One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    keyed = filled.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", F.lit(7), "role"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    repeated = (keyed.where("copies > 0").groupBy("conv_id", "h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
                .where("first < last").select(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"))
    same = keyed["conv_id"].eqNullSafe(F.col("c")) & (keyed["h1"] == F.col("g1")) & (keyed["h2"] == F.col("g2"))
    seen = F.coalesce(F.col("first") < at, F.lit(False))
    marked = keyed.join(repeated, same, "left").select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)

    conv = rows.schema["conv_id"].dataType.simpleString()
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.string()] * 2 + [
        pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    names = [c.split()[0] for c in f"{RESULT}, part int, seq int, n long, first_turn long, last_turn long, turns long, first string, last string, edges x".split(", ")]
    found = stage(dealt.mapInArrow(_scan(kind, names, types), f"conv_id {conv}, {RESULT}, {PIECE}"), "conversations")

    outputs = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]]
    joined = stage(found.where("part is not null").groupBy("conv_id").applyInArrow(_join(kind), f"conv_id {conv}, {RESULT}"), "segments")
    split = joined.where("repaired_sha256 is null")
    heads = split.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(True).alias("head"))
    theirs = filled.join(split.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").withColumn("head", F.lit(False))
    streamed = heads.unionByName(theirs).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), "turn", "role", "text")
    digests = streamed.mapInArrow(_digests(["c", "sha"], kind), f"c {conv}, sha string")
    hashed = split.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("repaired_sha256", F.col("sha")).select(*outputs)
    return found.where("part is null").select(*outputs).unionByName(joined.where("repaired_sha256 is not null").select(*outputs)).unionByName(hashed)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
