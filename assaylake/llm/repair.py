"""Repair of conversation structure by a Viterbi search that emits edits as soon as they are certain.

A conversation should be nothing, or an optional system row and then user and assistant rows in turn, each pair
complete. Edits keep a row, give it the role user or assistant, delete it, or insert an empty row; the cheapest
sequence wins, and of equally cheap ones that whose initials (D, I, K, R) sort first.

The search keeps one best path for each state of the pattern. Paths share their beginnings, as a tree of
backpointers with reference counts: what no path needs goes, and once all paths share an ancestor everything up to it
is certain and leaves the task. Paths of equal cost are compared over all that is unresolved. A path that costs
strictly more than another one that can do the same from here is given up; that never loses a tie.

Semantics. Rows go by `turn` (null first), ties by role, then text; equal rows are repeats. A null role or text is one
space. A null conv_id is a conversation like others. Texts of any length are taken whole. A role that begins with none
of s, u and a, or is empty, cannot be kept. A conversation is read in order by one task, which holds only rows not yet
certain: a few, except where roles say nothing at all for long stretches. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""

# What has been said so far: nothing, the system row, a user row last, an assistant row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
COMPLETE = (NOTHING, ASSISTANT)
FOLLOWS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EXPECTED = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: (worse, better): cost at which a path in state `better` can do all that one in state `worse` can. Insertions, which
#: join the states of the pattern's circle, are already in each layer of the search.
STANDS_IN = {(NOTHING, ASSISTANT): DELETE, (SYSTEM, ASSISTANT): 0, (SYSTEM, NOTHING): 0}


class Edit:
    """One edit at the end of a path: a node of the tree. `users` counts the paths and edits that end in or build on it."""

    __slots__ = ("before", "depth", "kids", "mark", "row", "users")

    def __init__(self, before: Edit | None, mark: str, row: tuple):
        self.before, self.mark, self.row, self.users, self.kids = before, mark, row, 0, []
        self.depth = 0
        if before is not None:
            self.depth = before.depth + 1
            before.users += 1
            before.kids.append(self)


def let_go(edit: Edit) -> None:
    """Without users an edit leaves the tree, and so does what only it built on."""
    while edit.users == 0 and edit.before is not None:
        edit.before.kids.remove(edit)
        edit.before.users -= 1
        edit = edit.before


def sorts_before(a: Edit, b: Edit) -> bool:
    """Whether the initials of path a come before those of path b; compared from where they part."""
    ours, theirs = [], []
    while a is not b:
        if a.depth >= b.depth:
            ours.append(a.mark)
            a = a.before
        else:
            theirs.append(b.mark)
            b = b.before
    return ours[::-1] < theirs[::-1]


class Search:
    """The best paths over the rows seen so far; `add` gives the edits that have become certain."""

    def __init__(self):
        self.root = Edit(None, "", ())
        self.paths: dict[int, tuple[int, Edit]] = {}
        self._settle({NOTHING: (0, self.root)})

    def _better(self, found: dict, state: int, cost: int, edit: Edit) -> None:
        now = found.get(state)
        if now is None or cost < now[0] or (cost == now[0] and sorts_before(edit, now[1])):
            found[state] = (cost, edit)
            if now is not None:
                let_go(now[1])
        else:
            let_go(edit)

    def _settle(self, found: dict[int, tuple[int, Edit]]) -> None:
        """Add what insertions reach, cheapest first, and drop what another path replaces at less cost."""
        for _, edit in found.values():
            edit.users += 1
        done: set[int] = set()
        while len(done) < len(found):
            state = min((s for s in found if s not in done), key=lambda s: found[s][0])
            done.add(state)
            cost, edit = found[state]
            role = EXPECTED[state]
            to = FOLLOWS[state, role[0]]
            if to not in done and (to not in found or cost + INSERT <= found[to][0]):
                if to in found:
                    found[to][1].users -= 1
                self._better(found, to, cost + INSERT, Edit(edit, "I", ("", role, "", None, SOUND, INSERT)))
                found[to][1].users += 1
        for (worse, better), extra in STANDS_IN.items():
            if worse in found and better in found and found[worse][0] > found[better][0] + extra:
                edit = found.pop(worse)[1]
                edit.users -= 1
                let_go(edit)
        for _, edit in self.paths.values():
            edit.users -= 1
            let_go(edit)
        self.paths = found

    def add(self, role: str, text: str, turn: int | None, fault: str) -> list[Edit]:
        cut = CUT * (fault == TRUNCATED)
        found: dict[int, tuple[int, Edit]] = {}
        for state, (cost, edit) in self.paths.items():
            self._better(found, state, cost + DELETE, Edit(edit, "D", (role, None, None, turn, fault, DELETE)))
            if fault in (BLANK, DUPLICATE):
                continue
            to = FOLLOWS.get((state, role[:1]))
            if to is not None:
                self._better(found, to, cost + cut, Edit(edit, "K", (role, role, text, turn, fault, cut)))
            said = EXPECTED[state]
            self._better(found, FOLLOWS[state, said[0]], cost + REROLE + cut, Edit(edit, "R", (role, said, text, turn, fault, REROLE + cut)))
        self._settle(found)
        return self._certain()

    def _certain(self) -> list[Edit]:
        """All paths pass through the root's only child, as long as it has but one and no path ends at the root."""
        out = []
        while self.root.users == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.before = None
            out.append(self.root)
        return out

    def end(self) -> list[Edit]:
        """The edits still open, on the best path that ends a complete conversation."""
        best: Edit | None = None
        least = 0
        for cost, edit in (self.paths[s] for s in COMPLETE if s in self.paths):
            if best is None or cost < least or (cost == least and sorts_before(edit, best)):
                best, least = edit, cost
        out = []
        while best is not None and best is not self.root:
            out.append(best)
            best = best.before
        return out[::-1]


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault) by each row's first fault, dealt by conversation and in order within it.

    One shuffle serves the search for repeats and the order of turns; both sort where the rows then lie.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    told = F.rtrim("text", F.lit(SPACE))
    fault = F.when(told == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(told, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return whole.withColumn("seen", seen).select("conv_id", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text")


EDITS = "conv_id long, step long, edit string, turn long, was_role string, role string, text string, fault string, cost long"
_EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _batches(rows: Iterator[tuple], names: str, types: list[pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    columns = [x.split()[0] for x in names.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], columns)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], columns)


def _read(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of `rows` (conv_id, turn, role, text), in order by conversation and step.

    was_role is the row's role before; role and text are what the repaired conversation has, null for a deleted row.
    """

    def edits(batches) -> Iterator[tuple]:
        search, conv, step = None, None, 0

        def told(found: list[Edit]) -> Iterator[tuple]:
            nonlocal step
            for e in found:
                was, role, text, turn, fault, cost = e.row
                yield conv, step, e.mark, turn, was, role, text, fault, cost
                step += 1

        for of, turn, role, text, fault in _read(batches):
            if search is None or of != conv:
                if search is not None:
                    yield from told(search.end())
                search, conv, step = Search(), of, 0
            yield from told(search.add(role, text, turn, fault))
        if search is not None:
            yield from told(search.end())

    return faults(rows).mapInArrow(lambda batches: _batches(edits(batches), EDITS, _EDIT_TYPES), EDITS)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def summaries(edits: DataFrame) -> DataFrame:
    """A row for each conversation of repair()'s edits, read in the order in which they come: nothing is shuffled."""

    def fold(batches) -> Iterator[tuple]:
        conv, first, last = None, None, None
        counts: dict[str, int] = {}
        audit: list[str] = []
        digest, said, begun, before, turns, illegal, cost = hashlib.sha256(), False, False, None, 0, 0, 0

        def done() -> tuple:
            gaps = last - first + 1 - turns if turns else 0
            return (conv, gaps, *(counts.get(f, 0) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, "".join(audit), digest.hexdigest())

        for of, _, mark, turn, was, role, text, fault, price in _read(batches):
            if not begun or of != conv:
                if begun:
                    yield done()
                conv, first, last, counts, audit, digest = of, None, None, {}, [], hashlib.sha256()
                said, begun, before, turns, illegal, cost = False, True, None, 0, 0, 0
            audit.append(mark)
            cost += price
            if role is not None:
                digest.update(f"{chr(10) * said}{role}:{text}".encode("utf-8", "surrogatepass"))
                said = True
            if mark == "I":
                continue
            counts[fault] = counts.get(fault, 0) + 1
            illegal += before is not None and before + was[:1] not in LEGAL
            before = was[:1]
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
        if begun:
            yield done()

    types = [pa.int64()] * 7 + [pa.string()] * 2
    return edits.mapInArrow(lambda batches: _batches(fold(batches), SUMMARY, types), SUMMARY)


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults planted by a checksum of their place: of 20, 0 drops a row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20
    whole = rows.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return whole.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def every_conversation(found: DataFrame, rows: DataFrame) -> DataFrame:
    """summaries() with a row of zeros for each conversation of `rows` of which nothing is left."""
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    names = [c.split()[0] for c in SUMMARY.split(", ")][1:]
    return joined.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in names))
