"""Repair of conversation structure by an error-correcting Earley parse (op 12).

A conversation's rows, by turn, should have roles of the form ``(s?(ua)+)?`` by their initials: perhaps a system turn, then
user and assistant in turn. Rows are kept, deleted, given another role, or joined by inserted empty rows at the least cost:

    keep 0, rerole to user or assistant 2, insert user or assistant 2, delete 3; a truncated row that stays adds 1.

Blank rows and repeats of an earlier row (role and text) must be deleted. Among the cheapest repairs the one whose edits'
initials (D, I, K, R in order) are least is taken.

Parsing: the grammar is left-linear, so all items of a chart start at its beginning and a chart has as many items as the
grammar has dots: time is linear in the rows. Scanning a row keeps or reroles it, every item may delete it, and inserts
advance an item within its chart; items are closed in order of (cost, audit) and retain the least of these. No two
cheapest audits of one prefix are each other's beginning (the longer would hold further inserts, at a cost), so the least audit of a
whole extends least ones of its parts: parses may start at any chart and be joined.

Scale: rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any size is spread over
partitions. A task streams its range, a conversation that lies within one task and has ``CHUNK`` rows at most is finished there.
Longer ones, and those at either end of a range, become chunks with a table of the best (cost, audit) from each state to each
other; these tables alone are folded by conversation, and the texts then stream once past the chosen audits, as
SHA-256 needs them in order. Equal rows of a turn are counted before the sort, so no number of copies makes a range large.

Defined cases: a null conv_id is a conversation of its own; null turns come first and don't count for gaps; null roles and
texts are one space, so a null text is blank and a null role must change; rows of one turn go by role, then text, as damaged, and equal
ones are repeats; very long texts cost their own size (one is held at a time besides its chunk's); other columns are ignored;
an empty table gives no rows; a conversation that lost all rows has zeros, no audit and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, importable

RULES = [("dialogue", ()), ("dialogue", ("pairs",)), ("system", ("s",)), ("user", ("u",)), ("user", ("system", "u")), ("user", ("pairs", "u")), ("pairs", ("user", "a"))]
#: What a parse can have behind it: nothing, or a nonterminal that ends there.
STATES = ("", "system", "user", "pairs")
ROLE = {"u": "user", "a": "assistant"}
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
#: Rows and bytes of text of a chunk; one row may be longer.
CHUNK, CHUNK_BYTES = 512, 4 << 20

Item = tuple[int, int]  #: a rule and how many of its symbols are behind the dot
Value = tuple[int, str]  #: cost and audit


class Token(NamedTuple):
    initial: str
    fault: str  #: "", or one of: truncated, blank, duplicate
    n: int  #: equal rows


def _next(item: Item) -> str:
    symbols = RULES[item[0]][1]
    return symbols[item[1]] if item[1] < len(symbols) else ""


def close(chart: dict[Item, Value]) -> dict[Item, Value]:
    """The chart with all that completions and inserts add, without items that nothing can advance."""
    agenda = [(value, item) for item, value in chart.items()]
    heapq.heapify(agenda)
    done: dict[Item, Value] = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = value
        symbol = _next(item)
        if not symbol:
            name = RULES[item[0]][0]
            for k, (_, symbols) in enumerate(RULES):
                if symbols and symbols[0] == name and (k, 1) not in done:
                    heapq.heappush(agenda, (value, (k, 1)))
        elif symbol in ROLE:
            heapq.heappush(agenda, ((value[0] + INSERT, value[1] + "I"), (item[0], item[1] + 1)))
    return {item: value for item, value in done.items() if _next(item) or RULES[item[0]][0] == "dialogue"}


def begin(state: str) -> dict[Item, Value]:
    """The first chart of a parse with ``state`` behind it."""
    zero = (0, "")
    if not state:  # predictions: dots before terminals, and the empty dialogue
        return close({(k, 0): zero for k, (_, symbols) in enumerate(RULES) if not symbols or len(symbols[0]) == 1})
    return close({(k, len(symbols)): zero for k, (name, symbols) in enumerate(RULES) if name == state})


def step(chart: dict[Item, Value], token: Token) -> dict[Item, Value]:
    """The chart behind a row (or equal rows, of which all but the first are repeats)."""
    must_go = token.fault in ("blank", "duplicate")
    n = token.n if must_go else 1
    new = {item: (cost + DELETE * n, audit + "D" * n) for item, (cost, audit) in chart.items()}
    if not must_go:
        late = TRUNCATED if token.fault else 0
        for item, (cost, audit) in chart.items():
            symbol = _next(item)
            ways = [(cost + late, audit + "K")] if symbol and symbol == token.initial else []
            if symbol in ROLE:
                ways.append((cost + REROLE + late, audit + "R"))
            for way in ways:
                over = (item[0], item[1] + 1)
                new[over] = min(new.get(over, way), way)
    new = close(new)
    return step(new, Token(token.initial, "duplicate", token.n - 1)) if not must_go and token.n > 1 else new


#: The item that waits behind each state, with the state's value.
_WAITING = {"": (0, 0), "system": (4, 1), "user": (6, 1), "pairs": (1, 1)}


def parse(tokens: Iterable[Token], state: str = "") -> dict[str, Value]:
    """The least (cost, audit) with which the rows lead from ``state`` to each other state."""
    chart = begin(state)
    for token in tokens:
        chart = step(chart, token)
    return {to: chart[item] for to, item in _WAITING.items() if item in chart}


def best(ends: dict[str, Value]) -> Value:
    """Of a whole conversation: it may end with nothing, or with whole pairs."""
    return min(ends[s] for s in ("", "pairs") if s in ends)


def repaired(rows: Iterator[tuple[str, str, int]], audit: str, state: str = "") -> Iterator[str]:
    """``role:text`` of what stays or is inserted; ``rows``: role, text, n."""
    left = 0
    role = text = ""
    for edit in audit:
        if edit != "I":
            if not left:
                role, text, left = next(rows)
            left -= 1
        if edit == "D":
            continue
        want = "a" if state == "user" else "u"
        if edit == "K":
            want = role[:1]
            yield f"{role}:{text}"
        else:
            yield f"{ROLE[want]}:{text if edit == 'R' else ''}"
        state = {"s": "system", "u": "user", "a": "pairs"}[want]


# --- rows ---


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows), gone: the rows after damage. A dropped row stays as one with ``gone``
    and nothing else, so that its conversation is known."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"))
    action = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("*", action.alias("action"))
    gone = F.col("action") == 0
    new = rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("action") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("action") == 1), "").when(F.col("action") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        gone.alias("gone"),
        F.when(F.col("action") == 3, 2).otherwise(1).alias("copies"),
    )
    return new.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.sum("copies").alias("n"))


def faulted(rows: DataFrame) -> DataFrame:
    """``rows`` with fault: of its first copy; further copies are repeats unless they are blank."""
    key = F.sha2("text", 256)  # the text itself travels once
    rows = rows.withColumn("key", key)
    first = rows.where(~F.col("gone")).groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    both = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["key"] == first["k"]), "left")
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    whole = F.rtrim("text", F.lit(" \t\n\v\f\r")).rlike("[.!?]\\z")
    fault = F.when(blank, "blank").when(~F.struct("turn").eqNullSafe(F.col("first")), "duplicate").when(~whole, "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "text", "gone", "n", fault.alias("fault"))


# --- chunks ---


class _Run:
    """Rows of one conversation, next to each other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.chunk = conv_id, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.tokens: list[Token] = []
        self.bytes = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.first, self.last = None, None

    def add(self, turn: int | None, role: str, text: str, n: int, fault: str) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.count["illegal"] += n - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if fault in ("blank", "duplicate"):
            self.count[fault] += n
        else:
            self.count["duplicate"] += n - 1
            self.count["truncated"] += fault == "truncated"
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.tokens.append(Token(initial, fault, n))
        self.rows.append((role, text, n))
        self.bytes += len(text)

    def record(self, part: int, whole: bool) -> dict:
        own = {"conv_id": self.conv_id, "part": part, "chunk": self.chunk, "first": self.first, "last": self.last, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.count}
        if whole:
            cost, audit = best(parse(self.tokens))
            text = hashlib.sha256("\n".join(repaired(iter(self.rows), audit)).encode("utf-8", "surrogatepass")).hexdigest()
            return own | {"cost": cost, "audit": audit, "repaired_sha256": text, "table": None, "rows": None}
        table = [{"start": a, "end": b, "cost": c, "audit": x} for a in STATES for b, (c, x) in parse(self.tokens, a).items()]
        rows = [{"role": r, "text": t, "n": n} for r, t, n in self.rows]
        return own | {"cost": None, "audit": None, "repaired_sha256": None, "table": table, "rows": rows}


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_RECORD = (
    f"conv_id long, part int, chunk int, first string, last string, turns long, first_turn long, last_turn long, {_COUNTS}, cost long, audit string, repaired_sha256 string, "
    "table array<struct<start: string, end: string, cost: long, audit: string>>, rows array<struct<role: string, text: string, n: long>>"
)
_TEXTS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_TABLE = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("table", _TABLE), ("rows", _TEXTS)]
)


def _written(records: Iterable[tuple[dict, int]]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK_BYTES; with each record its size."""
    held, size = [], 0
    for record, own in records:
        held.append(record)
        size += own
        if size >= CHUNK_BYTES or len(held) >= 2000:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _records(batches: Iterator[pa.RecordBatch], part: int, most: int) -> Iterator[tuple[dict, int]]:
    run, inner = None, False
    for b in batches:
        for conv_id, turn, role, text, gone, n, fault in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "n", "fault")], strict=True):
            if run is None or run.conv_id != conv_id:
                if run is not None:
                    yield run.record(part, inner and not run.chunk), run.bytes + 200
                    inner = True
                run = _Run(conv_id)
            elif len(run.rows) >= most or run.bytes >= CHUNK_BYTES:
                yield run.record(part, False), run.bytes + 200
                run.chunk += 1
                run.clear()
            if not gone:
                run.add(turn, role, text, n, fault)
    if run is not None:  # the next range may go on with it
        yield run.record(part, False), run.bytes + 200


def chunked(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """Finished conversations, and chunks of up to ``most`` rows of the others."""
    order = ["conv_id", "turn", "role", "text"]  # nulls first, as Spark sorts
    at = rows.repartitionByRange(*order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(_records(batches, TaskContext.get().partitionId(), most))

    return at.select(*order, "gone", "n", "fault").mapInArrow(run, _RECORD)


# --- conversations of several chunks ---


def _fold(chunks: Iterable[dict]) -> tuple[dict, list[dict]]:
    """Counts of a conversation whose chunks come in order, and for each chunk its (part, chunk, start, audit)."""
    total = {c: 0 for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    first_turn = last_turn = last = None
    ways: dict[str, tuple[int, str, tuple | None]] = {"": (0, "", None)}  # by state: cost, audit without the beginning that all share, path
    places = []
    for c in chunks:
        for name in total:
            total[name] += c[name]
        if c["first"] is not None:
            total["illegal"] += last is not None and last + c["first"] not in ("su", "ua", "au")
            last = c["last"]
        if c["first_turn"] is not None:
            total["turns"] -= c["first_turn"] == last_turn
            first_turn, last_turn = c["first_turn"] if first_turn is None else first_turn, c["last_turn"]
        new: dict[str, tuple[int, str, tuple | None]] = {}
        for e in c["table"]:
            if e["start"] in ways:
                cost, tail, path = ways[e["start"]]
                way = (cost + e["cost"], tail + e["audit"], (path, e["audit"], e["start"]))
                if e["end"] not in new or way[:2] < new[e["end"]][:2]:
                    new[e["end"]] = way
        shared = len(os.path.commonprefix([tail for _, tail, _ in new.values()]))
        ways = {state: (cost, tail[shared:], path) for state, (cost, tail, path) in new.items()}
        places.append((c["part"], c["chunk"]))
    cost, _, path = min((ways[s] for s in ("", "pairs") if s in ways), key=lambda w: w[:2])
    gaps = last_turn - first_turn + 1 - total.pop("turns") if first_turn is not None else 0
    steps = []
    for part, chunk in reversed(places):
        path, audit, start = path
        steps.append({"part": part, "chunk": chunk, "start": start, "own": audit})
    steps.reverse()
    total.pop("turns", None)
    return total | {"gaps": gaps, "cost": cost, "audit": "".join(s["own"] for s in steps)}, steps


_FOLDED = f"conv_id long, gaps long, {_COUNTS}, cost long, audit string, steps array<struct<part: int, chunk: int, start: string, own: string>>"


def folded(chunks: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit, and steps: the start and audit of each of its chunks. Tables only, no texts."""
    names = ["part", "chunk", "first", "last", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "table"]
    own = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("start", pa.string()), ("own", pa.string())]))
        schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("steps", steps)])
        for b in batches:
            for conv_id, chunks in zip(b.column("conv_id"), b.column("chunks"), strict=True):
                total, steps = _fold(chunks.as_py())
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id.as_py(), "steps": steps} | total], schema=schema)

    return own.mapInArrow(run, _FOLDED)


def hashed(chunks: DataFrame, steps: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: chunks stream in order past their audits."""
    s = steps.select(F.col("conv_id").alias("c"), F.explode("steps").alias("s")).select("c", "s.*")
    on = chunks["conv_id"].eqNullSafe(s["c"]) & (chunks["part"] == s["part"]) & (chunks["chunk"] == s["chunk"])
    texts = chunks.join(s, on).select(chunks["conv_id"], chunks["part"], chunks["chunk"], "rows", "start", "own")
    texts = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, some, done = None, None, False, []
        for b in batches:
            for k in range(b.num_rows):
                conv_id = b.column("conv_id")[k].as_py()
                if digest is None or conv_id != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest, some = conv_id, hashlib.sha256(), False
                rows = ((r["role"], r["text"], r["n"]) for r in (x.as_py() for x in b.column("rows")[k].values or []))
                for line in repaired(rows, b.column("own")[k].as_py(), b.column("start")[k].as_py()):
                    digest.update((b"\n" if some else b"") + line.encode("utf-8", "surrogatepass"))
                    some = True
        if digest is not None:
            done.append((at, digest.hexdigest()))
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in done], pa.int64()), "repaired_sha256": pa.array([x for _, x in done], pa.string())})

    return texts.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of ``rows``
    (conv_id, turn, role, text, n, gone)."""
    importable(rows.sparkSession)
    found = cut(chunked(faulted(rows), most), "conversation-chunks")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = found.where("table IS NULL").select("conv_id", gaps, *columns, "repaired_sha256")
    chunks = found.where("table IS NOT NULL")
    steps = cut(folded(chunks), "conversation-steps")
    texts = hashed(chunks, steps).withColumnRenamed("conv_id", "c")
    joined = steps.join(texts, steps["conv_id"].eqNullSafe(texts["c"])).select("conv_id", "gaps", *columns, "repaired_sha256")
    return whole.union(joined)


def repair_damaged(conversations: DataFrame, most: int = CHUNK) -> DataFrame:
    """``repair`` of the conversations as ``damaged`` leaves them."""
    return repair(damaged(conversations), most)
