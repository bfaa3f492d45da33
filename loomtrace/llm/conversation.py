"""Repair of conversation structure: the cheapest edits that give well-formed turns.

The roles of a repaired conversation are an optional system turn and then user and assistant in
turn. The cheapest way there is a shortest path through four states (nothing yet; after system,
user, assistant), one stage a row. It is found in one reading: each state has one survivor, the
cheapest path into it, and of equally cheap ones that whose edits come first in the alphabet.

Survivors are kept as a tree. An edit stands in it once, however many survivors run through it,
a node counts the survivors' branches below it, and one with a single branch left is joined with
it. What stands above all branches is therefore decided: it is emitted at once and forgotten, so
that memory holds only edits still open. Ties are settled on all of the open part: where two
survivors part, they part by different letters. A survivor that another can follow at less cost,
whatever comes, is dropped. Rows that must go take one entry a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtrace.llm.common import table

# Costs of the edits, and what is added for a row that stays though it is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1

# ASCII white space, the signs that end a sentence, and the roles that an edit can give.
SPACE = " \t\n\v\f\r"
SENTENCE_ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}

# The states are named by the last role's initial, the first one by "".
START = ""
#: What may come next in each state; ends are allowed in START and "a".
NEXT = {START: "su", "s": "u", "u": "a", "a": "u"}
#: BRIDGE[p][q]: at this extra cost p can follow any way on from q (deleting a system row, inserting turns).
BRIDGE = {
    START: {"s": 0, "u": 2, "a": 0}, "s": {START: 4, "u": 2, "a": 4},
    "u": {START: 5, "s": 2, "a": 2}, "a": {START: 3, "s": 0, "u": 2},
}
_BATCH_BYTES = 8 << 20


@dataclass(slots=True)
class Edit:
    """One edit (K, R, D or I), or a run of D; ``role`` and ``text`` are the repaired row's."""

    letter: str
    role: str | None = None
    text: str | None = None
    count: int = 1


class Node:
    """A stretch of edits that the survivors below it share; its reference count is its branches."""

    __slots__ = ("parent", "branches", "edits")

    def __init__(self, parent: Node | None):
        self.parent, self.branches, self.edits = parent, [], []
        if parent is not None:
            parent.branches.append(self)

    def add(self, edit: Edit) -> None:
        last = self.edits[-1] if self.edits else None
        if edit.letter == "D" and last is not None and last.letter == "D":
            last.count += 1
        else:
            self.edits.append(edit)


def _joined(above: list[Edit], below: list[Edit]) -> list[Edit]:
    if above and below and above[-1].letter == below[0].letter == "D":
        above[-1].count += below[0].count
        above.extend(below[1:])
    else:
        above.extend(below)
    return above


class Repair:
    """Reads one conversation row by row; ``row`` and ``end`` return the edits that became certain."""

    def __init__(self):
        self.root = Node(None)
        self.cost: dict[str, int] = {START: 0}
        self.leaf: dict[str, Node] = {START: self.root}
        self._insert()

    def row(self, role: str, text: str, fault: str) -> list[Edit]:
        """``fault``: "blank" or "duplicate" rows must go, "truncated" ones cost more if they stay."""
        extra = CUT_OFF if fault == "truncated" else 0
        choices: dict[str, tuple[int, str, Edit]] = {}

        def offer(state: str, cost: int, source: str, edit: Edit) -> None:
            old = choices.get(state)
            if old is None or cost < old[0] or cost == old[0] and self._before(source, edit, old[1], old[2]):
                choices[state] = (cost, source, edit)

        for state, cost in self.cost.items():
            offer(state, cost + DELETE, state, Edit("D"))
            if fault in ("blank", "duplicate"):
                continue
            initial = role[:1]
            if initial and initial in NEXT[state]:
                offer(initial, cost + extra, state, Edit("K", role, text))
            for initial in NEXT[state]:
                if initial in ROLES:
                    offer(initial, cost + extra + REROLE, state, Edit("R", ROLES[initial], text))
        self._move(choices)
        self._insert()
        self._drop_dominated()
        return self._certain()

    def end(self) -> tuple[int, list[Edit]]:
        """The cost of the whole conversation, and the last edits."""
        ends = [s for s in (START, "a") if s in self.cost]
        best = min(ends, key=lambda s: self.cost[s])
        for other in ends:
            if other != best and self.cost[other] == self.cost[best] and self._before(other, None, best, None):
                best = other
        for state in [s for s in self.leaf if s != best]:
            self._release(self.leaf.pop(state))
        return self.cost[best], self._certain()

    def _before(self, one: str, edit: Edit | None, other: str, other_edit: Edit | None) -> bool:
        """Whether the survivor of ``one``, with ``edit``, comes before that of ``other`` with its own."""
        a, b = self.leaf[one], self.leaf[other]
        if a is b:
            return edit.letter < other_edit.letter
        up = []
        while a is not None:
            up.append(a)
            a = a.parent
        down = []
        while b not in up:
            down.append(b)
            b = b.parent

        def first(nodes: list[Node], last: Edit | None) -> str:
            for node in reversed(nodes):
                if node.edits:
                    return node.edits[0].letter
            return last.letter if last is not None else ""

        return first(up[:up.index(b)], edit) < first(down, other_edit)

    def _move(self, choices: dict[str, tuple[int, str, Edit]]) -> None:
        """Give each state its chosen survivor, one edit longer."""
        users: dict[str, list[str]] = {s: [] for s in self.leaf}
        for state, (_, source, _) in choices.items():
            users[source].append(state)
        leaf, old = {}, self.leaf
        for source, states in users.items():
            for state in states:
                leaf[state] = old[source] if len(states) == 1 else Node(old[source])
                leaf[state].add(choices[state][2])
        for source, states in users.items():
            if not states:
                self._release(old[source])
        self.leaf, self.cost = leaf, {s: c[0] for s, c in choices.items()}

    def _insert(self) -> None:
        """Let each state be reached from another by an inserted turn, cheapest states first."""
        open_states = dict(self.cost)
        while open_states:
            state = min(open_states, key=open_states.get)
            cost = open_states.pop(state)
            target = next(i for i in NEXT[state] if i in ROLES)
            edit = Edit("I", ROLES[target], "")
            old = self.cost.get(target)
            if old is not None and (cost + INSERT > old or cost + INSERT == old and not self._before(
                    state, edit, target, None)):
                continue
            if target in self.leaf:
                self._release(self.leaf.pop(target))
            shared = self.leaf[state]
            self.leaf[state], self.leaf[target] = Node(shared), Node(shared)
            self.leaf[target].add(edit)
            self.cost[target] = open_states[target] = cost + INSERT

    def _drop_dominated(self) -> None:
        for state in list(self.cost):
            if any(self.cost[p] + BRIDGE[p][state] < self.cost[state] for p in self.cost if p != state):
                self._release(self.leaf.pop(state))
                del self.cost[state]

    def _release(self, node: Node) -> None:
        """Take a survivor's end off the tree; a node left with one branch is joined with it."""
        parent = node.parent
        parent.branches.remove(node)
        if len(parent.branches) == 1:
            only = parent.branches[0]
            only.edits, only.parent = _joined(parent.edits, only.edits), parent.parent
            if parent.parent is None:
                self.root = only
            else:
                parent.parent.branches[parent.parent.branches.index(parent)] = only

    def _certain(self) -> list[Edit]:
        found, self.root.edits = self.root.edits, []
        return found


# ---- In tasks

@dataclass
class Summary:
    """What is counted of a conversation on the way."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    last_initial: str | None = None
    audit: list[str] = field(default_factory=list)
    lines: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = role[:1]
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn

    def edits(self, edits: Iterable[Edit]) -> None:
        for edit in edits:
            self.audit.append(edit.letter * edit.count)
            if edit.letter != "D":
                self.digest.update(f"{chr(10) if self.lines else ''}{edit.role}:{edit.text}".encode())
                self.lines += 1

    def result(self, cost: int) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit),
                self.digest.hexdigest())


def fault_of(text: str, seen: bool) -> str:
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return "" if bare[-1] in SENTENCE_ENDS else "truncated"


COLUMNS = ("conv_id", "turn", "role", "text", "present", "seen")
SUMMARY = [
    *[StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    StructField("audit", StringType()), StructField("repaired_sha256", StringType()),
]
EDITS = [StructField("place", LongType())] + [StructField(n, StringType()) for n in ("edit", "role", "text")]


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """("row", conv_id, turn, role, text, fault), and ("end", conv_id) after the last row of each."""
    open_id, any_open = None, False
    for batch in batches:
        for conv_id, turn, role, text, present, seen in zip(
                *(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
            if any_open and conv_id != open_id:
                yield "end", open_id
            open_id, any_open = conv_id, True
            if present:
                yield "row", conv_id, turn, role, text, fault_of(text, seen)
    if any_open:
        yield "end", open_id


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    repair, summary = Repair(), Summary()
    for event in _conversations(batches):
        if event[0] == "row":
            _, _, turn, role, text, fault = event
            summary.row(turn, role, fault)
            summary.edits(repair.row(role, text, fault))
        else:
            cost, edits = repair.end()
            summary.edits(edits)
            yield event[1], *summary.result(cost)
            repair, summary = Repair(), Summary()


def _edit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    repair, place = Repair(), 0
    for event in _conversations(batches):
        edits = repair.row(*event[3:]) if event[0] == "row" else repair.end()[1]
        for edit in edits:
            for _ in range(edit.count):
                yield event[1], place, edit.letter, edit.role, edit.text
                place += 1
        if event[0] == "end":
            repair, place = Repair(), 0


# ---- On Spark

def _streamed(rows: DataFrame, make, fields: list[StructField]) -> DataFrame:
    """``make`` over the rows of each conversation in order; a conversation is one sorted stream of one task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # One exchange serves the window and the stream; both sorts spill to disk.
    by_conversation = rows.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")
    ordered = by_conversation.withColumn("seen", F.row_number().over(earlier) > 1).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text").select(*COLUMNS)
    schema = StructType([rows.schema["conv_id"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in make(batches):
            held.append(row)
            size += 200 + sum(len(x) for x in row if isinstance(x, str))
            if size > _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in held], schema=arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in held], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _clean(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present; a null role or text is one space, and nothing is absent unless marked."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    return conversations.select(
        "conv_id", F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
                                                 for c in ("role", "text")], present.alias("present"))


def repair_summary(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` has conv_id, turn, role, text and may have ``present``: rows where it is
    false only make their conversation known. Rows are taken by turn, nulls first, then by role
    and text. A null conv_id is a conversation of its own; a null role or text counts as one
    space. A conversation without rows has zeros, an empty audit and the hash of the empty text.
    Other columns are ignored; an empty table gives no row. A conversation is read as a stream:
    memory is bounded by its open edits, its length only takes time and room for the sort.
    """
    return _streamed(_clean(conversations), _summaries, SUMMARY)


def repair_edits(conversations: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, place (from 0), edit (K, R, D, I), and the repaired role and text.

    Input as for ``repair_summary``. Role and text are null for deleted rows; an inserted turn has an
    empty text. The rows with a role, in order of place, are the repaired conversation.
    """
    return _streamed(_clean(conversations), _edit_rows, EDITS)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn``; dropped rows stay with ``present`` false."""
    def name(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    return conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"),
                                fault.alias("fault")).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", SENTENCE_ENDS, ""))
        .otherwise(F.col("text")).alias("text"), (F.col("fault") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by a recursive query: a row of it holds the survivors after one row of each conversation."""
    def more(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return (f"CASE WHEN {state} IS NOT NULL AND {when} THEN "
                f"{{'c': {state}.c + {cost}, 'h': {state}.h || '{letter}', 'r': {lines}}} END")

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def arrive(initial: str, sources: str) -> str:
        role = ROLES[initial]
        kept = [more(f"w.{s}", "d.cut", "K", "d.role || ':' || d.text", f"NOT d.gone AND d.initial = '{initial}'")
                for s in sources]
        renamed = [more(f"w.{s}", f"d.cut + {REROLE}", "R", f"'{role}:' || d.text", "NOT d.gone") for s in sources]
        return best(more(f"w.{initial}", str(DELETE), "D"), *kept, *renamed)

    def insert(state: str, initial: str) -> str:
        return more(state, str(INSERT), "I", f"'{ROLES[initial]}:'")

    to_system = best(more("w.s", str(DELETE), "D"),
                     more("w.e", "d.cut", "K", "d.role || ':' || d.text", "NOT d.gone AND d.initial = 's'"))
    nothing = "CAST(NULL AS STRUCT(c BIGINT, h VARCHAR, r VARCHAR[]))"
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE codes AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), coded AS (
    SELECT keyed.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fault
    FROM keyed, codes
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE fault <> 0
), numbered AS (
    SELECT *, left(role, 1) AS initial,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
    FROM damaged
), flagged AS (
    SELECT *, NOT regexp_matches(text, '[^{space}]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           regexp_extract(text, '([^{space}])[{space}]*$', 1) NOT IN ('.', '!', '?') AS cut_off,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
    FROM numbered
), d AS (
    SELECT *, blank OR again AS gone, CASE WHEN cut_off THEN {CUT_OFF} ELSE 0 END AS cut FROM flagged
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, e, {nothing} AS s, {insert('e', 'u')} AS u,
           {{'c': 4::BIGINT, 'h': 'II', 'r': ['user:', 'assistant:']}} AS a
    FROM (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'h': '', 'r': []::VARCHAR[]}} AS e FROM conversations)
    UNION ALL
    SELECT conv_id, i, e, s, u, {best('a', insert('u', 'a'))} AS a FROM (
        SELECT conv_id, i, e, s, a, {best('u', insert('e', 'u'), insert('s', 'u'), insert('a', 'u'))} AS u FROM (
            SELECT w.conv_id, d.i, {more('w.e', str(DELETE), 'D')} AS e, {to_system} AS s,
                   {arrive('u', 'esa')} AS u, {arrive('a', 'u')} AS a
            FROM walk w JOIN d ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = w.i + 1
        )
    )
), ended AS (
    SELECT conv_id, {best('e', 'a')} AS way FROM walk
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (cut_off AND NOT blank AND NOT again) AS truncated, count(*) FILTER (illegal) AS illegal
    FROM d GROUP BY conv_id
)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.c AS cost, way.h AS audit,
       sha256(array_to_string(way.r, chr(10))) AS repaired_sha256
FROM ended LEFT JOIN counted ON ended.conv_id IS NOT DISTINCT FROM counted.conv_id
"""


ORACLE_SQL = _sql()
