"""Repair of conversations whose turns are out of structure, by weighted interval parsing.

The roles of a sound conversation read ``(s?(ua)+)?``. Its grammar in Chomsky normal form has a
symbol for each pair of states (before, after) of that pattern: ``pq -> pr rq``, and a single row is
derived by one edit: Keep (0), Rerole to user or assistant (1), Delete (2); blank rows and
duplicates have to go, and a truncated row that stays adds 5. Insertions (5) stand on no row; each
cell is closed under them. A cell holds the least (cost, audit) of a symbol over a span of rows, the
audit being the edits' initials. Spans are combined bottom-up by length. As a derivation is in one
state at each place, every split of a span gives the same cell, so one split a span is enough: a
span of n rows takes n combinations of four by four cells. Equal costs go to the least audit; two
audits of one cell and cost never begin one another, so least parts make least wholes.

Faults are found and spans are parsed on rows without their texts, dealt by ranges of
(conversation, turn), so a conversation of very many rows is parsed in many tasks; spans that touch
an end of a task's rows are combined in a second step. Texts are then read once more beside the
audits, as a stream in order, and each repaired turn is passed on or digested as it comes. The
digest of one conversation is a sequence, and so one task's work, in memory of one batch.

Defined results: null roles and texts count as one space; rows without a conversation are one
conversation; rows are taken by turn (nulls first), ties by role and by the digest of conversation,
role and text; a kept row keeps its role as it is written; conversations that are named but have no
rows have no faults and an empty repair; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.ids import counted
from vacantia.llm.memory import small_batches
from vacantia.sources.scratch import checkpointed

#: States: nothing said, after the system's turn, after a user's, after an assistant's; ends.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: Rows of a span that is remembered, and spans that are.
SHORT, REMEMBERED = 64, 50_000
_BLANK, _STOP = r"^[\x20\x09-\x0D]*$", r"[.!?][\x20\x09-\x0D]*$"

Cell = tuple[int, str] | None
Cells = tuple[Cell, ...]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out: list[Cell] = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            a = left[STATES * p + r]
            if a is None:
                continue
            for q in range(STATES):
                b = right[STATES * r + q]
                if b is not None:
                    new = (a[0] + b[0], a[1] + b[1])
                    old = out[STATES * p + q]
                    if old is None or new < old:
                        out[STATES * p + q] = new
    return tuple(out)


def _cells(edges: list[tuple[int, int, int, str]]) -> Cells:
    out: list[Cell] = [None] * (STATES * STATES)
    for p, q, cost, edit in edges:
        old = out[STATES * p + q]
        if old is None or (cost, edit) < old:
            out[STATES * p + q] = (cost, edit)
    return tuple(out)


_STAY = [(p, p, 0, "") for p in range(STATES)]
_INSERT = _cells(_STAY + [(p, q, INSERT, "I") for (p, role), q in STEPS.items() if role != "s"])
#: No row: what insertions alone lead to.
EMPTY = combined(combined(_INSERT, _INSERT), _INSERT)


@lru_cache(64)
def _leaf(symbol: str) -> Cells:
    """A row: ``d`` has to go, else the role's initial, in capitals if the row is truncated."""
    edges = [(p, p, DELETE, "D") for p in range(STATES)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        edges += [(p, q, more, "K") for (p, role), q in STEPS.items() if role == symbol.lower()]
        edges += [(p, q, REROLE + more, "R") for (p, role), q in STEPS.items() if role != "s"]
    return combined(combined(EMPTY, _cells(edges)), EMPTY)


@lru_cache(REMEMBERED)
def _short(symbols: str) -> Cells:
    if len(symbols) <= 1:
        return _leaf(symbols) if symbols else EMPTY
    half = 1 << ((len(symbols) - 1).bit_length() - 1)
    return combined(_short(symbols[:half]), _short(symbols[half:]))


def parsed(symbols: str) -> Cells:
    """Cells of a span of rows; longer spans from pairs of equally long ones."""
    level = [_short(symbols[i : i + SHORT]) for i in range(0, len(symbols), SHORT)] or [EMPTY]
    while len(level) > 1:
        level = [combined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(cells: Cells) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    return min(c for q in ENDS if (c := cells[q]) is not None)


def roles_of(audit: str) -> Callable[[int], str]:
    """The role of each turn of a repair: an odd number of turns begins with the system's."""
    odd = (len(audit) - audit.count("D")) % 2
    return lambda i: "system" if odd and i == 0 else ("user", "assistant")[(i - odd) % 2]


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired turns from the edits and the rows, as they come."""
    role, i, edits = roles_of(audit), 0, iter(audit)
    for edit in edits:
        if edit == "I":
            yield role(i), ""
        else:
            said, text = next(rows)
            if edit == "D":
                continue
            yield (said if edit == "K" else role(i)), text
        i += 1


# -- faults -------------------------------------------------------------------------------------


def _key() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("same")]


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text, and ``same``: a digest of
    conversation, role and text."""
    conv, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select(conv, turn, role, text)
    return rows.withColumn("same", F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their text: the role's initial and the first fault of each but for adjacent
    repeats, which the stream of rows in order tells."""
    light = rows.select("conv_id", "turn", "role", "same", F.rlike("text", F.lit(_BLANK)).alias("blank"), (~F.rlike("text", F.lit(_STOP))).alias("truncated"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    several = light.groupBy("same").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    seen = light.join(counted(several), "same", "left").withColumn("place", place)
    return seen.select("conv_id", "turn", "role", "same", "blank", "truncated", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
_SPAN = f"conv_id long, open boolean, part long, {_COUNTS}, head string, tail string, cells array<struct<cost: long, audit: string>>"


class _Span:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.last = conv, [], None
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.head = self.tail = None

    def add(self, turn: int | None, role: str, same: str, blank: bool, truncated: bool, later: bool) -> None:
        duplicate = later or self.last == (turn, role, same)
        self.last = (turn, role, same)
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.n[fault] += 1
        initial = role[:1]
        if self.tail is not None and self.tail + initial not in LEGAL:
            self.n["illegal"] += 1
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None:
            self.n["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append("d" if blank or duplicate else symbol.upper() if truncated else symbol)

    def row(self, part: int, open_: bool) -> tuple:
        cells: list = list(parsed("".join(self.symbols)))
        if not open_:
            cells = [best(tuple(cells))]
        said = [c and {"cost": c[0], "audit": c[1]} for c in cells]
        return (self.conv, open_, part, *self.n.values(), self.low, self.high, self.head, self.tail, said)


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("open", pa.bool_()), ("part", pa.int64())]
    + [(c.split()[0], pa.int64()) for c in _COUNTS.split(", ")]
    + [("head", pa.string()), ("tail", pa.string()), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, now, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        done = []
        for conv, real, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row(part, first))
                    first = False
                now = _Span(conv)
            if real:
                now.add(*rest)
        yield _batch(done)
    if now is not None:
        yield _batch([now.row(part, True)])


def _joined(table: pa.Table) -> pa.Table:
    """One conversation's spans in order of their parts, as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = dict(rows[0])
    cells = [tuple(c and (c["cost"], c["audit"]) for c in r["cells"]) for r in rows]
    for r in rows[1:]:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            total[k] += r[k]
        if total["tail"] is not None and r["head"] is not None:
            total["illegal"] += total["tail"] + r["head"] not in LEGAL
        total["turns"] -= total["high"] is not None and total["high"] == r["low"]
        total["head"] = r["head"] if total["head"] is None else total["head"]
        total["tail"] = total["tail"] if r["tail"] is None else r["tail"]
        total["low"] = r["low"] if total["low"] is None else total["low"]
        total["high"] = total["high"] if r["high"] is None else r["high"]
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    cost, audit = best(cells[0])
    total["cells"], total["open"] = [{"cost": cost, "audit": audit}], False
    return pa.Table.from_pylist([total], schema=_ARROW)


def audits(rows: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, faults, and the cost and audit of its cheapest repair. ``named``:
    conversations (conv_id) to report also if they have no rows."""
    light = faults(rows).withColumn("real", F.lit(True))
    if named is not None:
        light = light.unionByName(named.select(F.col("conv_id").cast("long")).distinct().withColumn("real", F.lit(False)), allowMissingColumns=True)
    light = light.repartitionByRange(*_key()).sortWithinPartitions(*_key())
    spans = checkpointed(light.select("conv_id", "real", "turn", "role", "same", "blank", "truncated", "later").mapInArrow(_spans, _SPAN))
    whole = spans.where("NOT open").union(spans.where("open").groupBy("conv_id").applyInArrow(_joined, _SPAN))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return whole.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", F.col("cells")[0]["cost"].alias("cost"), F.col("cells")[0]["audit"].alias("audit"))


# -- repairs ------------------------------------------------------------------------------------


def _stream(rows: DataFrame, found: DataFrame, emit: Callable, schema: T.StructType) -> DataFrame:
    """``emit(head, turns)`` for each conversation: its row of ``audits`` and its repaired turns."""
    small_batches(rows.sparkSession)
    head = found.select("conv_id", F.struct(*[F.col(c) for c in found.columns]).alias("head"))
    both = head.unionByName(rows.select("conv_id", "turn", "role", "same", "text"), allowMissingColumns=True)
    first = F.col("head").isNull()
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", first, *_key()[1:]).select("conv_id", "head", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Peeked((h, (r, t)) for b in batches for h, r, t in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True))
        kind = pa.schema([(f.name, _KINDS[f.dataType.typeName()]) for f in schema.fields])
        out: list[dict] = []
        while held.more():
            head, _ = held.take()
            for row in emit(head, repaired(head["audit"], held.rest())):
                out.append(row)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return both.mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "string": pa.string()}


class _Peeked:
    """Rows of many conversations, each after the row that heads it."""

    def __init__(self, rows: Iterator[tuple[dict | None, tuple[str, str]]]):
        self._rows, self._next = rows, next(rows, None)

    def more(self) -> bool:
        return self._next is not None

    def take(self) -> tuple[dict | None, tuple[str, str]]:
        out, self._next = self._next, next(self._rows, None)
        return out

    def rest(self) -> Iterator[tuple[str, str]]:
        """The rows up to the next head."""
        while self._next is not None and self._next[0] is None:
            yield self.take()[1]


_SHA = "repaired_sha256"
DIGESTED = T.StructType([T.StructField(c, T.StringType() if c in ("audit", _SHA) else T.LongType()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", _SHA)])
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _digest(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[dict]:
    h = sha256()
    for i, (role, text) in enumerate(turns):
        h.update(f"{'' if i == 0 else chr(10)}{role}:{text}".encode())
    yield head | {_SHA: h.hexdigest()}


def _turns(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[dict]:
    for i, (role, text) in enumerate(turns):
        yield {"conv_id": head["conv_id"], "position": i, "role": role, "text": text}


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, role, text)."""
    rows = rows_of(conversations)
    return _stream(rows, audits(rows), _turns, TURNS)


def repaired_digests(conversations: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """``audits`` with the digest of each conversation's repaired turns, ``role:text`` by lines."""
    rows = rows_of(conversations)
    return _stream(rows, audits(rows, named), _digest, DIGESTED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one in four rows damaged, by a checksum of its conversation and turn: 0
    drops it, 1 empties its text, 2 takes out full stops, 3 repeats it, 4 gives it to the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repaired_digests(damaged(conversations), conversations)


def report_sql() -> str:
    """DuckDB SQL for ``report``: a table over rows and states, row by row, with states as text of the
    cost in eight digits and the audit."""

    def edit(state: str, cost: str, initial: str) -> str:
        return f"(lpad((left({state}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{initial}')"

    into: dict[int, list[str]] = {q: [edit(f"s{q}", str(DELETE), "D")] for q in range(STATES)}
    for (p, role), q in STEPS.items():
        stays = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        into[q].append(f"CASE WHEN stays AND initial = '{role}' THEN {edit(f's{p}', stays, 'K')} END")
        if role != "s":
            into[q].append(f"CASE WHEN stays THEN {edit(f's{p}', f'{REROLE} + {stays}', 'R')} END")
    put = ", ".join(f"least({', '.join(x)}) AS s{q}" if len(x) > 1 else f"{x[0]} AS s{q}" for q, x in into.items())
    again = f"s0, s1, least(s2, {', '.join(edit(f's{p}', str(INSERT), 'I') for p in (0, 1, 3))}) AS s2, s3"
    then = f"s0, s1, s2, least(s3, {edit('s2', str(INSERT), 'I')}) AS s3"
    more = f"s0, s1, least(s2, {edit('s3', str(INSERT), 'I')}) AS s2, s3"
    closed = lambda rows: f"SELECT conv_id, i, {more} FROM (SELECT conv_id, i, {then} FROM (SELECT conv_id, i, {again} FROM ({rows})))"
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT c.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM c, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(conv_id::VARCHAR, ' ') || ':' || strlen(role) || ':' || role || text), copy) AS i, left(role, 1) AS initial FROM d),
f AS (SELECT *, CASE WHEN regexp_full_match(text, '{space}*') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{space}*$') THEN 'truncated' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS ({closed("SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations")}
  UNION ALL {closed(f"SELECT r.conv_id, r.i, {put} FROM p JOIN (SELECT *, fault IS NULL OR fault = 'truncated' AS stays FROM f) r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1")}),
e AS (SELECT p.conv_id, least(s0, s3) AS found FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n, 0)),
a AS (SELECT conv_id, left(found, 8)::BIGINT AS cost, substr(found, 9) AS audit FROM e),
u AS (SELECT conv_id, j, substr(audit, j::INT, 1) AS x, (len(audit) - len(replace(audit, 'D', ''))) AS gone, len(audit) AS n FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM a)),
w AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i, sum((x <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY j) - 1 AS nth, (n - gone) % 2 AS odd FROM u),
z AS (SELECT w.conv_id, string_agg(CASE WHEN x = 'K' THEN f.role WHEN odd = 1 AND nth = 0 THEN 'system' WHEN (nth - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j) AS said
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE x <> 'D' GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
