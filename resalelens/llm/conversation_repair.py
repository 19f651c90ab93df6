"""Repair the role structure of conversations at the lowest cost, with an audit of the edits.

Messages of a conversation are ordered by turn, nulls first; messages of one turn by role
and then by a hash of their text, so equal ones are adjacent. The first fault of a message counts: ``blank``
(nothing but blanks), ``duplicate`` (role and text seen earlier in the conversation),
``truncated`` (the last character that is no blank is not ``.``, ``!`` or ``?``). Edits are
Keep (0), Rerole to the role that fits (1), Delete (2; the only one for blank and duplicate
messages) and Insert of an empty message (5); a truncated message that stays adds 5. The
initials of the roles that are left must read ``(s?(ua)+)?``. Of the cheapest audits, strings
of edit initials, the least one is taken.

The search is a dynamic programme over four states. Audits are never copied: a prefix is a
node that points to the one before it, with ancestors at powers of two and a rolling hash.
Equal costs are settled by a search for the longest common prefix over those ancestors, and
equal hashes are confirmed edit by edit (once per pair of nodes). Two audits that lead to
the same state at the same cost are never prefixes of each other, since inserts cost.

A conversation may be any length. Messages are sorted over all tasks by conversation and
turn; a conversation that crosses the border of a task, or has more than ``SEGMENT``
messages, is solved in segments: cheapest audits from each state to each state, which are
then put together in order. That needs the length of the audit, which is one value of the
result. Texts take no part in this and are read once more to replay the audits; a message
table or digest of one conversation comes out of one task in order, batch by batch, since
a digest has to see its bytes in sequence.

Null roles and texts are one space, so such a text is blank; conversations without id are
one conversation. Repeated rows are duplicates. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from resalelens.llm.tables import bounded_batches
from resalelens.operators.storage import written

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept message, by state and role initial.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Role of a message that is inserted or given another role, and the state after it.
FITS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
RIGHT_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults as the search sees them.
SOUND, MUST_GO, CUT_OFF = range(3)
SEGMENT = 4_096
BASE, PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """All audit prefixes of one search as a tree of nodes; node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self.equal_to: dict[int, int] = {}

    def add(self, node: int, edit: str) -> int:
        ups, at, k = [node], node, 0
        while len(self.up[at]) > k:
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        self.up.append(ups)
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _known(self, node: int) -> int:
        while node in self.equal_to:
            node = self.equal_to[node]
        return node

    def confirmed(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth stand for the same edits."""
        walked = []
        while (a := self._known(a)) != (b := self._known(b)):
            if self.edit[a] != self.edit[b]:
                return False
            walked.append((max(a, b), min(a, b)))
            a, b = self.up[a][0], self.up[b][0]
        for high, low in walked:
            if high not in self.equal_to:
                self.equal_to[high] = low
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` sorts before audit ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self.confirmed(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.confirmed(self.up[x][0], self.up[y][0]):
            return self.edit[x] < self.edit[y]
        return self.text(a) < self.text(b)


class Search:
    """Cheapest audits over a run of messages, from one state on."""

    def __init__(self, state: int = START):
        self.audits = Audits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[state] = (0, 0)

    def _pick(self, offers: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        """Cheapest of (cost, node, next edit); no edit means the node itself."""
        if not offers:
            return None
        least = min(cost for cost, _, _ in offers)
        tied = [(node, edit) for cost, node, edit in offers if cost == least]
        nodes = [self.audits.add(node, edit) if edit else node for node, edit in tied]
        won = nodes[0]
        for node in nodes[1:]:
            if self.audits.less(node, won):
                won = node
        return least, won

    def insert(self) -> None:
        """Best states when any messages may be inserted first. From one accepted shape to
        another two inserts are enough, so a user and then an assistant message."""
        for state, before in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            own = self.best[state]
            offers = [(b[0] + INSERT, b[1], "I") for s in before if (b := self.best[s])]
            if own:
                offers = [(*own, "")] + [o for o in offers if o[0] <= own[0]]
            self.best[state] = self._pick(offers)

    def read(self, initial: str, fault: int) -> None:
        self.insert()
        offers: list[list] = [[], [], [], []]
        extra = TRUNCATED if fault == CUT_OFF else 0
        for state, found in enumerate(self.best):
            if found is None:
                continue
            cost, node = found
            offers[state].append((cost + DELETE, node, "D"))
            if fault != MUST_GO:
                after = AFTER.get((state, initial))
                if after is not None:
                    offers[after].append((cost + extra, node, "K"))
                offers[NEXT[state]].append((cost + REROLE + extra, node, "R"))
        self.best = [self._pick(o) for o in offers]

    def end(self) -> tuple[int, str]:
        self.insert()
        cost, node = self._pick([(*self.best[s], "") for s in (START, ASSISTANT) if self.best[s]])
        return cost, self.audits.text(node)


class _Run:
    """Messages of one conversation, as far as one segment of one task has them."""

    def __init__(self, conv, states: tuple[int, ...], part: int, ordinal: int):
        self.conv, self.part, self.ordinal = conv, part, ordinal
        self.searches = {s: Search(s) for s in states}
        self.first = self.last = None
        self.n = self.illegal = 0

    def read(self, initial: str, fault: int) -> None:
        for search in self.searches.values():
            search.read(initial, fault)
        if self.n:
            self.illegal += self.last + initial not in RIGHT_PAIRS
        else:
            self.first = initial
        self.last = initial
        self.n += 1

    def whole(self) -> list[tuple]:
        cost, audit = self.searches[START].end()
        return [(self.conv, self.part, self.ordinal, False, START, ASSISTANT, cost, audit, self.illegal, self.first, self.last)]

    def open(self) -> list[tuple]:
        return [
            (self.conv, self.part, self.ordinal, True, start, state, found[0], search.audits.text(found[1]), self.illegal, self.first, self.last)
            for start, search in self.searches.items() for state, found in enumerate(search.best) if found]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


ANY = (START, SYSTEM, USER, ASSISTANT)


def _segments(conv_type: str):
    """Arrow function over sorted ``conv_id, initial, fault``."""
    def solve(batches):
        schema, part = None, TaskContext.get().partitionId()
        run, first, rows = None, True, []
        for batch in batches:
            schema = pa.schema(
                [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("ordinal", pa.int32()), ("open", pa.bool_()),
                 ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
                 ("first", pa.string()), ("last", pa.string())])
            for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))):
                if run is None or conv != run.conv:
                    if run is not None:
                        rows += run.open() if first or run.ordinal else run.whole()
                        first = False
                    run = _Run(conv, ANY if first else (START,), part, 0)
                elif run.n == SEGMENT:
                    rows += run.open()
                    run = _Run(conv, ANY, part, run.ordinal + 1)
                run.read(initial, fault)
            yield _arrow(rows, schema)
            rows = []
        if run is not None:
            yield _arrow(run.open(), schema)
    return solve, (
        f"conv_id {conv_type}, part int, ordinal int, open boolean, start int, state int, cost long, audit string, illegal long, "
        "first string, last string")


class _Joined:
    """Segments of one conversation put together in order. An audit is a chain of pieces."""

    def __init__(self, conv):
        self.conv, self.at, self.last, self.illegal = conv, None, None, 0
        self.best: dict[int, tuple] = {START: (0, None)}
        self.new: dict[int, tuple] = {}

    @staticmethod
    def _less(a, b) -> bool:
        mine, other = [], []
        while a is not b:
            mine.append(a[1])
            other.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(mine)) < "".join(reversed(other))

    def _offer(self, table: dict, state: int, cost: int, chain) -> None:
        own = table.get(state)
        if own is None or cost < own[0] or cost == own[0] and self._less(chain, own[1]):
            table[state] = (cost, chain)

    def read(self, row: dict) -> None:
        if (row["part"], row["ordinal"]) != self.at:
            self.step()
            self.at = (row["part"], row["ordinal"])
            self.illegal += row["illegal"]
            if self.last is not None:
                self.illegal += self.last + row["first"] not in RIGHT_PAIRS
            self.last = row["last"]
        if before := self.best.get(row["start"]):
            self._offer(self.new, row["state"], before[0] + row["cost"], (before[1], row["audit"]))

    def step(self) -> None:
        if self.at is not None:
            self.best, self.new = self.new, {}

    def end(self) -> tuple:
        self.step()
        best = {s: (cost, self._text(chain)) for s, (cost, chain) in self.best.items()}
        for state, before in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            offers = [(best[s][0] + INSERT, best[s][1] + "I") for s in before if s in best]
            best[state] = min([best[state]] * (state in best) + offers)
        cost, audit = min(best[s] for s in (START, ASSISTANT) if s in best)
        return self.conv, cost, audit, self.illegal

    @staticmethod
    def _text(chain) -> str:
        out = []
        while chain is not None:
            out.append(chain[1])
            chain = chain[0]
        return "".join(reversed(out))


def _joined(batches):
    """Arrow function over segments sorted by conversation, task and ordinal."""
    joined, names = None, ["conv_id", "cost", "audit", "illegal"]
    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64()]
        schema, rows = pa.schema(list(zip(names, kinds))), []
        for row in batch.to_pylist():
            if joined is None or row["conv_id"] != joined.conv:
                if joined is not None:
                    rows.append(joined.end())
                joined = _Joined(row["conv_id"])
            joined.read(row)
        yield _arrow(rows, schema)
    if joined is not None:
        yield _arrow([joined.end()], schema)


def _replay(batches):
    """(conv, place, edit, role, text) of each repaired message in order, and (conv, None)
    at the end of each conversation; a conversation starts with the row of its audit."""
    edits = conv = None
    state = place = 0

    def inserted():
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            yield conv, place, "I", FITS[state], ""
            state, place, at = NEXT[state], place + 1, at + 1

    at = 0
    for batch in batches:
        for new, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if edits is not None:
                    yield from inserted()
                    yield conv, None
                conv, edits, at, state, place = new, audit, 0, START, 0
                continue
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "K":
                state = AFTER[state, role[:1]]
            elif edit == "R":
                role, state = FITS[state], NEXT[state]
            if edit != "D":
                yield conv, place, edit, role, text
                place += 1
    if edits is not None:
        yield from inserted()
        yield conv, None


def _messages(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def write(batches):
        rows, size = [], 0
        for found in _replay(batches):
            if found[1] is None:
                continue
            rows.append(found)
            size += len(found[4]) + 64
            if size > 1 << 22:
                yield _arrow(rows, schema)
                rows, size = [], 0
        yield _arrow(rows, schema)
    return write


def _digests(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("sha256", pa.string())])

    def write(batches):
        rows, sha = [], hashlib.sha256()
        for found in _replay(batches):
            if found[1] is None:
                rows.append((found[0], sha.hexdigest()))
                sha = hashlib.sha256()
            else:
                sha.update(f"{chr(10) if found[1] else ''}{found[3]}:{found[4]}".encode())
            if len(rows) == 10_000:
                yield _arrow(rows, schema)
                rows = []
        yield _arrow(rows, schema)
    return write


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by the CRC-32 of ``conv_id:turn``
    modulo 20: 0 drops the message, 1 empties it, 2 takes its sentence ends, 3 repeats it,
    4 makes it the user's."""
    kind = F.crc32(F.concat(_text(F.col(conv_id)), F.lit(":"), _text(F.col(turn)))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.translate(_text(F.col(text)), ENDS, "")).otherwise(_text(F.col(text)))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(_text(F.col(role))).alias("role"), body.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


class Repair:
    """Cheapest repair of a table with ``conv_id, turn, role, text``.

    ``conversations``: per conversation the faults, cost and audit; ``messages()``: the
    repaired messages; ``digests()``: SHA-256 per conversation of its ``role:text`` lines."""

    def __init__(self, rows: DataFrame):
        bounded_batches(rows.sparkSession)
        self.rows = written(
            rows.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
            .withColumn("seq", F.monotonically_increasing_id()), "messages")
        self.conv_type = dict(self.rows.dtypes)["conv_id"]
        light = self._light()
        self.audits = self._search(light)
        self.conversations = self._counts(light).join(
            self.audits.withColumnRenamed("conv_id", "_of"), F.col("conv_id").eqNullSafe(F.col("_of")), "left").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _light(self) -> DataFrame:
        """Messages without texts, faults found: no message is looked at twice after this."""
        blanks = F.lit(BLANKS)
        solid = F.rtrim(F.col("text"), blanks)
        marked = self.rows.select(
            "conv_id", "turn", "role", "seq", F.xxhash64("text").alias("mark"), F.md5(F.encode("text", "UTF-8")).alias("sum"),
            (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(*ENDS)).alias("cut"))
        first = (
            marked.groupBy("conv_id", "role", "sum").agg(F.min(F.struct("turn", "seq")).alias("_first"))
            .select(F.col("_first.seq").alias("seq"), F.lit(True).alias("_is_first")))
        fault = F.when(F.col("blank"), "blank").when(F.col("_is_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
        return written(
            marked.join(first, "seq", "left").select(
                "conv_id", "turn", "role", "mark", "seq", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "faults")

    def _search(self, light: DataFrame) -> DataFrame:
        order = ["conv_id", "turn", "role", "mark", "seq"]
        code = F.when(F.col("fault") == "truncated", CUT_OFF).when(F.col("fault").isNotNull(), MUST_GO).otherwise(SOUND)
        ready = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "initial", code.alias("fault"))
        solve, schema = _segments(self.conv_type)
        found = written(ready.mapInArrow(solve, schema), "segments")
        cut = found.filter("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "ordinal", "start", "state")
        joined = cut.mapInArrow(_joined, f"conv_id {self.conv_type}, cost long, audit string, illegal long")
        return written(found.filter("NOT open").select("conv_id", "cost", "audit", "illegal").unionAll(joined), "audits")

    def _counts(self, light: DataFrame) -> DataFrame:
        """Turns are counted per (conversation, turn) first, so a large one is spread."""
        kinds = [F.sum((F.coalesce(F.col("fault"), F.lit("")) == kind).cast("long")).alias(kind) for kind in ("blank", "duplicate", "truncated")]
        turns = light.groupBy("conv_id", "turn").agg(*kinds)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
        return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))

    def _replayed(self) -> DataFrame:
        """Audits and messages in the order of the search, a conversation in one task."""
        heads = self.audits.select("conv_id", F.lit(0).alias("kind"), "audit")
        rows = self.rows.withColumn("mark", F.xxhash64("text")).withColumn("kind", F.lit(1))
        return (
            heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", "turn", "role", "mark", "seq").select("conv_id", "audit", "role", "text"))

    def _arrow_type(self) -> pa.DataType:
        return to_arrow_type(self.rows.schema["conv_id"].dataType)

    def messages(self) -> DataFrame:
        """``conv_id, place, edit, role, text``; ``edit`` is Keep, Rerole or Insert."""
        return self._replayed().mapInArrow(
            _messages(self._arrow_type()), f"conv_id {self.conv_type}, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        return self._replayed().mapInArrow(_digests(self._arrow_type()), f"conv_id {self.conv_type}, sha256 string")
