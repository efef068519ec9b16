"""Least-cost repair of conversations by depth-first branch-and-bound.

Equal rows of a turn are counted, so that a conversation's rows can be dealt by ranges of (conversation, turn, role,
hash of the text) and read in order; each range is cut into segments of consecutive rows, a segment being a string of
marks (role initial and fault). For a segment a search with an explicit stack finds the cheapest edits, of equally
cheap ones the ASCII-least audit, for each state that the roles may be in before and after it. A node is a row and a
state. Children come in ASCII order of their edit, so that every node is reached by growing audits; a table of each
node's least cost drops later arrivals that are not cheaper, and a prefix goes once its cost and a lower bound of what
the remaining rows cost exceed the incumbent (cost, audit). A conversation of several
segments takes the best chain of states through their results: the audits of two chains that meet differ in a
character, so comparing them segment by segment is comparing them whole. A last pass streams rows and audits in order
into the repaired text's hash.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import shuffle_parts, stage, table

#: Rows of one segment; a search takes time between linear and quadratic in them.
SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What the roles so far are: none, a system row, ending in a user row, ending in an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a role's initial.
STEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The initial that a written row (rerole, insert) must have in a state.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
WRITTEN = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults in a mark: to be deleted, truncated, none.
MUST, SHORT, FINE = "x", "t", "."
#: White space that makes no row: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: Distinct segments whose results a worker remembers while a task lasts.
REMEMBERED = 20_000

SEGMENTS = ("conv_id long, seg long, marks string, turn long, role string, sha string, blank long, duplicate long, "
            "truncated long")
SOLVED = ("conv_id long, segment long, whole boolean, last boolean, turn long, role string, sha string, entry int, "
          "exit int, cost long, rank int, audit string, illegal long, first_role string, last_role string")


def suffix_bounds(marks: list[tuple[str, str]]) -> list[int]:
    """For each row the least that it and all after it cost in any state but START, where one system row may be free.

    Each row counts its cheapest edit; two neighbours that stay and have one role cost another 2 (a row between, another
    role, or 3 instead of at most 1 for a deletion), for as many pairs apart from each other as there are.
    """
    least = [0] * (len(marks) + 1)
    after = None  # the next row that need not be deleted
    for i in range(len(marks) - 1, -1, -1):
        role, fault = marks[i]
        if fault == MUST:
            least[i] = DELETE + least[i + 1]
            continue
        own = (KEEP if role in WRITTEN else REROLE) + (CUT if fault == SHORT else 0)
        least[i] = own + least[i + 1]
        if after is not None and role in WRITTEN and marks[after][0] == role:
            pair = own + (CUT if marks[after][1] == SHORT else 0) + REROLE + least[after + 1]
            least[i] = max(least[i], pair + DELETE * (after - i - 1))
        after = i
    return least


def search(marks: list[tuple[str, str]], entry: int, ends: tuple[int, ...], closing: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of `marks` from state `entry` to one of `ends`, ties to the least audit.

    Rows may be inserted before each row, and after the last one if `closing`. None if no edits lead there.
    """
    n, bounds = len(marks), suffix_bounds(marks)
    free = [False] * (n + 1)  # a system row that a START state may keep lies ahead
    for i in range(n - 1, -1, -1):
        free[i] = free[i + 1] or (marks[i][0] == "s" and marks[i][1] != MUST)
    early = not closing and ends[0] in (START, SYSTEM)  # all rows go but for a system row

    def bound(i: int, state: int) -> float:
        if early and state == ends[0]:
            return DELETE * (n - i)
        if early:
            return DELETE * (n - i - 1) if state == START and free[i] else float("inf")
        return bounds[i] - (REROLE if state == START and free[i] else 0)

    incumbent = None if early else _greedy(marks, entry, ends, closing)
    cheapest: dict[tuple[int, int], int] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cheapest.get((i, state), cost + 1) <= cost:
            continue
        least = cost + bound(i, state)
        if least == float("inf") or incumbent and (least, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        cheapest[i, state] = cost
        if i == n:
            if state in ends and (not incumbent or (cost, audit) < incumbent):
                incumbent = cost, audit
            if closing:
                stack.append((n, STEPS[state, NEXT[state]], cost + INSERT, audit + "I"))
            continue
        role, fault = marks[i]
        if fault != MUST:
            cut = CUT if fault == SHORT else 0
            stack.append((i + 1, STEPS[state, NEXT[state]], cost + REROLE + cut, audit + "R"))
            if (state, role) in STEPS:
                stack.append((i + 1, STEPS[state, role], cost + KEEP + cut, audit + "K"))
        stack.append((i, STEPS[state, NEXT[state]], cost + INSERT, audit + "I"))
        stack.append((i + 1, state, cost + DELETE, audit + "D"))
    return incumbent


def _greedy(marks: list[tuple[str, str]], entry: int, ends: tuple[int, ...], closing: bool) -> tuple[int, str] | None:
    """A first incumbent: keeps what fits, inserts before a user or assistant row that does not, reroles the rest.

    The last row that stays may instead get the role that leads to one of `ends`.
    """
    stay = [i for i, (_, fault) in enumerate(marks) if fault != MUST]
    found = []
    for turned in ("", "R", "IR"):
        state, cost, audit = entry, 0, ""
        for i, (role, fault) in enumerate(marks):
            if fault == MUST:
                cost, audit = cost + DELETE, audit + "D"
                continue
            cost += CUT if fault == SHORT else 0
            edits = turned if turned and i == stay[-1] else (
                "K" if (state, role) in STEPS else "IK" if role in WRITTEN else "R")
            for edit in edits:
                cost += {"K": KEEP, "I": INSERT, "R": REROLE}[edit]
                state = STEPS[state, role if edit == "K" else NEXT[state]]
            audit += edits
        while closing and state not in ends:
            state, cost, audit = STEPS[state, NEXT[state]], cost + INSERT, audit + "I"
        if state in ends:
            found.append((cost, audit))
    return min(found, default=None)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(batch: pa.RecordBatch, names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names.split()), strict=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows that come by conversation, turn, role and hash; a marker stands before the first of equal rows."""
    seg, conv, first_seen, marks, faults, head = TaskContext.get().partitionId() << 32, None, False, [], [0, 0, 0], None
    for batch in batches:
        out = []
        for conv_id, turn, role, sha, is_row, n, blank, short in _rows(batch, "conv_id turn role sha is_row n blank short"):
            if marks and conv_id != conv:
                out.append((conv, seg, "".join(marks), *head, *faults))
                seg, marks, faults = seg + 1, [], [0, 0, 0]
            conv = conv_id
            if not is_row:
                first_seen = True
                continue
            for copy in range(n):
                if not marks:
                    head = turn, role, sha
                fault = 0 if blank else 1 if copy or not first_seen else 2 if short else 3
                marks.append((role[0] if role[:1] in ("u", "a", "s") else "?") + (MUST, MUST, SHORT, FINE)[fault])
                if fault < 3:
                    faults[fault] += 1
                if len(marks) == SEGMENT:
                    out.append((conv, seg, "".join(marks), *head, *faults))
                    seg, marks, faults = seg + 1, [], [0, 0, 0]
            first_seen = False
        yield _batch(out, SEGMENTS)
    if marks:
        yield _batch([(conv, seg, "".join(marks), *head, *faults)], SEGMENTS)


def solve_segment(text: str, whole: bool, last: bool) -> tuple[list[tuple[int, int, int, int, str]], int]:
    """(entry, exit, cost, rank of the audit, audit) for each pair of states that matters, and neighbours not allowed."""
    marks = list(zip(text[::2], text[1::2], strict=True))
    ways = (
        [(START, ASSISTANT, (START, ASSISTANT))] if whole else
        [(e, ASSISTANT, (START, ASSISTANT)) for e in STATES] if last else [(e, x, (x,)) for e in STATES for x in STATES]
    )
    found = [(e, x, search(marks, e, ends, last)) for e, x, ends in ways]
    ranks = {a: n for n, a in enumerate(sorted({best[1] for *_, best in found if best}))}
    roles = [r for r, _ in marks]
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    return [(e, x, best[0], ranks[best[1]], best[1]) for e, x, best in found if best], illegal


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, bool, bool], tuple] = {}
    for batch in batches:
        out = []
        for *key, whole, last, text in _rows(batch, "conv_id segment turn role sha whole last marks"):
            if (text, whole, last) not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[text, whole, last] = solve_segment(text, whole, last)
            found, illegal = known[text, whole, last]
            conv_id, segment, turn, role, sha = key
            out += [(conv_id, segment, whole, last, turn, role, sha, *way, illegal, text[0], text[-2]) for way in found]
        yield _batch(out, SOLVED)


CHAIN = "conv_id long, segment long, entry int, exit int, border long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states that the best chain of each conversation takes, and whether two segments' neighbours are not allowed.

    Segments come in order. Of chains so far, cost and rank are held, of each segment four back pointers.
    """
    best, back, borders, before = {START: (0, 0)}, [], [], ""
    for batch in batches:
        out = []
        for conv_id, last, first_role, last_role, edges in _rows(batch, "conv_id last first_role last_role edges"):
            ahead: dict[int, tuple] = {}
            for e in edges:
                if e["entry"] in best:
                    cost, rank = best[e["entry"]]
                    way = (cost + e["cost"], rank, e["rank"], e["entry"])
                    ahead[e["exit"]] = min(ahead.get(e["exit"], way), way)
            ranks = {pair: n for n, pair in enumerate(sorted({way[1:3] for way in ahead.values()}))}
            best = {x: (way[0], ranks[way[1:3]]) for x, way in ahead.items()}
            back.append({x: way[3] for x, way in ahead.items()})
            borders.append(int(bool(before) and before + first_role not in LEGAL))
            before = last_role
            if last:
                state, path = ASSISTANT, []
                for pointers in reversed(back):
                    path.append((pointers[state], state))
                    state = pointers[state]
                out += [(conv_id, i + 1, *way, border) for i, (way, border) in enumerate(zip(path[::-1], borders, strict=True))]
                best, back, borders, before = {START: (0, 0)}, [], [], ""
        yield _batch(out, CHAIN)


DIGEST = "conv_id long, audit string, repaired_sha256 string"


class _Repaired:
    """The repaired text of one conversation as a running hash; audits come before the rows that they edit."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.digest, self.audits, self.waiting = conv_id, hashlib.sha256(), [], deque()
        self.state, self.started = START, False

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.started else "") + role + ":" + text).encode())
        self.state, self.started = STEPS[self.state, role[0]], True

    def add_audit(self, audit: str) -> None:
        self.audits.append(audit)
        self.waiting.extend(audit)

    def add_row(self, role: str, text: str) -> None:
        edit = self.insert()
        if edit == "K":
            self._write(role, text)
        elif edit == "R":
            self._write(WRITTEN[NEXT[self.state]], text)

    def insert(self) -> str:
        """Writes the rows that are inserted here; the next row's edit, or nothing after the last one."""
        while self.waiting:
            edit = self.waiting.popleft()
            if edit != "I":
                return edit
            self._write(WRITTEN[NEXT[self.state]], "")
        return ""

    def result(self) -> tuple:
        self.insert()
        return self.conv_id, "".join(self.audits), self.digest.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out = []
        for conv_id, copies, role, text, audit in _rows(batch, "conv_id copies role text audit"):
            if held is None or conv_id != held.conv_id:
                out += [held.result()] if held else []
                held = _Repaired(conv_id)
            if audit is not None:
                held.add_audit(audit)
            for _ in range(copies):
                held.add_row(role, text)
        yield _batch(out, DIGEST)
    if held:
        yield _batch([held.result()], DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after the damage that the checksum of `conv_id:turn` decides.

    A dropped row stays, with `copies` 0. Nulls count as one space, but conv_id and turn stay null in the result.
    """
    space = F.lit(" ")
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def solved_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of `rows` (conv_id, turn, role, text, copies), and the best edits of each: audit, cost, illegal."""
    parts = shuffle_parts(rows.sparkSession)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    equal = rows.where("copies > 0").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), "copies", (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("short"),
    ).groupBy("conv_id", "turn", "role", "sha").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("short").alias("short"))
    firsts = equal.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("at")).select(
        "conv_id", F.col("at.turn").alias("turn"), "role", "sha", F.lit(False).alias("is_row"))
    order = ["conv_id", "turn", "role", "sha"]
    segments = stage(
        equal.withColumn("is_row", F.lit(True)).unionByName(firsts, allowMissingColumns=True)
        .repartitionByRange(parts, *order).sortWithinPartitions(*order, "is_row").mapInArrow(_cut, SEGMENTS), "segments")

    all_of = Window.partitionBy("conv_id")
    numbered = segments.withColumn("segment", F.row_number().over(all_of.orderBy("seg")).cast("long")).withColumn(
        "of", F.count(F.lit(1)).over(all_of))
    solved = stage(
        numbered.withColumn("whole", F.col("of") == 1).withColumn("last", F.col("of") == F.col("segment"))
        .repartition(parts, "conv_id", "segment").mapInArrow(_solve, SOLVED), "solved")
    edges = solved.where("NOT whole").groupBy("conv_id", "segment", "last", "first_role", "last_role").agg(
        F.collect_list(F.struct("entry", "exit", "cost", "rank")).alias("edges"))
    chain = edges.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_chain, CHAIN).select(
        F.struct("conv_id", "segment", "entry", "exit").alias("way"), "border")
    key = F.struct("conv_id", "segment", "entry", "exit")
    best = solved.where("whole").withColumn("border", F.lit(0).cast("long")).unionByName(
        solved.where("NOT whole").join(chain, key.eqNullSafe(F.col("way"))).drop("way"))
    return segments, best.withColumn("illegal", F.col("illegal") + F.col("border"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows` (conv_id, turn, role, text, copies): its faults and its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows with `copies` 0
    only name their conversation; other columns are ignored. Rows come by turn, nulls first; rows that share a turn by
    role, then by the SHA-256 of their text, so that repeated rows stand together and the later ones are duplicates.
    Equality of texts is that of this hash. Rows without conv_id make one conversation. Role and text must not be null
    (`damaged` makes nulls one space); an empty role has no initial and fits nowhere. Without rows all counts are 0,
    the audit is empty and the hash that of the empty string; an empty table gives no rows. Texts may be very long, they
    are hashed whole. A conversation of any length is searched in segments by many tasks; only costs and the audits'
    ranks are chained, and its repaired text is hashed, which is sequential, in one task that holds one row at a time.
    """
    parts = shuffle_parts(rows.sparkSession)
    segments, best = solved_segments(rows)
    order = ["conv_id", "turn", "role", "sha"]
    texts = rows.where("copies > 0").withColumn("sha", F.sha2("text", 256)).withColumn("segment", F.lit(None).cast("long"))
    edits = best.select(*order, "segment", "audit", F.lit(0).alias("copies"))
    digests = texts.select(*order, "segment", "text", "copies").unionByName(edits, allowMissingColumns=True).repartition(
        parts, "conv_id").sortWithinPartitions(
            *order, F.asc_nulls_last("segment")).mapInArrow(_digest, DIGEST)
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    every = rows.groupBy("conv_id").agg(
        (F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)).alias("gaps"))
    faults = segments.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = best.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("illegal", "cost")))
    found = every
    for more in (faults, costs, digests):
        found = found.unionByName(more, allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


_CRC = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"
_STEP = "xor(c, b)"
for _ in range(8):
    _STEP = f"list_transform([{_STEP}], lambda v: {_CRC.format('v')})[1]"
#: A row of `steps` is the best way through a conversation's first i rows that leaves its roles in a state.
OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_STEP}), 4294967295) % 20 AS kind
  FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM given)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
moves(state, kept, leave) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
writes(state, leave, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
steps(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', {{cost: 0, audit: '', lines: CAST([] AS VARCHAR[])}} FROM judged
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    WITH entered AS (
      SELECT conv_id, i, state, best FROM steps
      UNION ALL
      SELECT conv_id, i, w.leave, {{cost: best.cost + 2, audit: best.audit || 'I', lines: list_append(best.lines, w.role || ':')}}
      FROM steps s JOIN writes w ON s.state = w.state),
    ahead AS (
      SELECT e.conv_id, e.state, e.best, j.i, j.role, j.text, j.fault IN ('blank', 'duplicate') AS must,
        CAST(j.fault = 'truncated' AS INTEGER) AS cut
      FROM entered e JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i + 1)
    SELECT conv_id, i, state, {{cost: best.cost + 3, audit: best.audit || 'D', lines: best.lines}} AS best FROM ahead
    UNION ALL
    SELECT conv_id, i, m.leave, {{cost: best.cost + cut, audit: best.audit || 'K', lines: list_append(best.lines, role || ':' || text)}}
    FROM ahead a JOIN moves m ON a.state = m.state AND left(a.role, 1) = m.kept WHERE NOT must
    UNION ALL
    SELECT conv_id, i, w.leave, {{cost: best.cost + 2 + cut, audit: best.audit || 'R', lines: list_append(best.lines, w.role || ':' || text)}}
    FROM ahead a JOIN writes w ON a.state = w.state WHERE NOT must) GROUP BY conv_id, i, state),
ended AS (
  SELECT s.conv_id, min(CASE s.state
    WHEN 'u' THEN {{cost: best.cost + 2, audit: best.audit || 'I', lines: list_append(best.lines, 'assistant:')}}
    WHEN 's' THEN {{cost: best.cost + 4, audit: best.audit || 'II', lines: list_concat(best.lines, ['user:', 'assistant:'])}}
    ELSE best END) AS best
  FROM steps s JOIN (SELECT DISTINCT conv_id, n FROM judged) j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.i = j.n
  GROUP BY s.conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal
  FROM judged GROUP BY conv_id)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN faults f ON g.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ended e ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""
