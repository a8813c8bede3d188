"""Conversation repair: the cheapest edits that make a conversation's roles alternate.

A conversation is well formed if its roles are nothing, or an optional system turn followed by
pairs of user and assistant turns. Rows may be kept, given another role, deleted, or new empty
turns put in; the edits of least cost are found by a shortest path over four states (start, after
system, after user, after assistant). Equal consecutive symbols (role and fault) form runs. A run
of n equal symbols moves the costs by the n-th power of its transition in the (min, +) algebra,
put together from cached powers of two; the choices of the rows inside it are then unrolled by
halving, so no run needs more than a logarithmic number of vectors.

How it runs in Spark: texts stay behind at first. Short rows (order, symbol, digest) are range
sorted and cut into blocks of at most ``BLOCK`` rows, so a conversation of any length is spread
over many tasks. A conversation inside one block is solved there. One that crosses blocks is
summed up in each as a table of 16 costs, and of the ranks of the edits that reach them; the
tables are put together per conversation (one row for ``BLOCK`` rows), which tells each block
from which state to which it must go. Only then are the texts sorted by conversation and streamed
once with the edits beside them.

Defined results:

- A null role or text is one space. Rows are ordered by turn, null first, and rows of one turn by
  the MD5 of their role and text. Equal rows of a turn are neighbours.
- A row's first fault counts: blank, duplicate (role and text seen before in the conversation),
  truncated (the last character that is no space is none of ``.!?``).
- A null ``conv_id`` is a conversation of its own. Roles that start with none of s, u, a, and
  empty roles, are out of place everywhere.
- A conversation without rows has zeros, an empty audit and the hash of the empty string. Columns
  other than conv_id, turn, role, text and copies are ignored; an empty table gives an empty
  result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialized, slices

#: rows of one block, at most
BLOCK = 8192

# fixed values: white space, and the characters that end a sentence
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# the state after a role, by its initial; a role that is out of place leads nowhere
STEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
GONE = "x"  # symbol of a row that must be deleted; others are an initial, upper case if truncated
LEGAL_PAIRS = {"su", "ua", "au"}

REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string"
)
DIGEST = REPORT + ", repaired_sha256 string"


# ---- rows and their faults


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as the repair of this corpus is tested on: dropped, emptied, cut, repeated or reroled.

    ``copies`` is 0 for a dropped row, 2 for a repeated one.
    """
    key = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.translate(text, ENDS, ""))
        .otherwise(text)
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _plain(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        copies.alias("copies"),
        digest.alias("digest"),
    )


def _symbols(plain: DataFrame) -> DataFrame:
    """One short row for equal rows of a turn: ``copies``, its symbol, and whether it is blank.

    Whether a text came before is found by the least turn of each (conversation, digest), which
    combines on the map side; that joins by the turn too, so a text that one conversation says
    a million times still spreads over all tasks.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    short = plain.select(
        "conv_id", "turn", "digest", "copies",
        initial.alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"),
    )
    rows = short.groupBy("conv_id", "turn", "digest").agg(
        F.sum("copies").alias("copies"),
        F.first("initial").alias("initial"),  # these three follow from the digest
        F.first("blank").alias("blank"),
        F.first("cut").alias("cut"),
    )
    first = (
        short.filter("copies > 0").groupBy("conv_id", "digest")
        .agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
        .select("conv_id", "digest", F.col("least.turn").alias("turn"), F.lit(True).alias("first"))
    )
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "digest")]
    return rows.alias("r").join(first.alias("f"), keys[0] & keys[1] & keys[2], "left").select(
        "r.conv_id", "r.turn", "r.digest", "copies", "initial", "blank", "cut",
        F.coalesce("first", F.lit(False)).alias("first"),
    )


def _blocks(symbols: DataFrame, block: int) -> DataFrame:
    """The rows in order, with ``at`` (ascending over all rows) and the block of each."""
    order = ["conv_id", "turn", "digest"]
    numbered = symbols.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()
    )
    return materialized(
        numbered.withColumn("block", F.floor(F.col("at") / F.lit(block)).cast("long")),
        "conversation-blocks",
    )


# ---- shortest paths


def _insertions(state: int) -> Iterator[tuple[int, int]]:
    """States that put-in turns lead to, and how many it takes."""
    yield state, 0
    at, steps = state, 0
    while steps < 2:
        at = USER if at != USER else ASSISTANT
        steps += 1
        if at == state:
            return
        yield at, steps


# turns to put in after the last row until the conversation may end
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
END_COSTS = tuple(INSERT * CLOSING[q] for q in STATES)
# "" before "I" before "II"
END_RANKS = tuple(CLOSING[q] for q in STATES)


@cache
def _edits(symbol: str) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, state, next state, cost) of the edits that use up a row of this symbol."""
    out = [("D", q, q, DELETE) for q in STATES]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        kept = STEPS.get(symbol.lower(), {})
        out += [("K", q, to, more) for q, to in kept.items()]
        out += [("R", q, to, REROLE + more) for r in "ua" for q, to in STEPS[r].items()]
    return tuple(out)


def _product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


@cache
def _power(symbol: str, log: int):
    """The transition of 2**log rows of one symbol, with the turns put in before each."""
    if log:
        half = _power(symbol, log - 1)
        return _product(half, half)
    matrix = [[FAR] * 4 for _ in STATES]
    for q in STATES:
        for at, steps in _insertions(q):
            for _, start, to, cost in _edits(symbol):
                if start == at:
                    matrix[q][to] = min(matrix[q][to], INSERT * steps + cost)
    return tuple(map(tuple, matrix))


@lru_cache(1 << 16)
def _before(symbol: str, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end from before a run, given those from behind it."""
    log = 0
    while n:
        if n & 1:
            m = _power(symbol, log)
            costs = tuple(min(min(m[q][k] + costs[k] for k in STATES), FAR) for q in STATES)
        n >>= 1
        log += 1
    return costs


@lru_cache(1 << 16)
def _choose(symbol: str, states: tuple[int, ...], costs: tuple[int, ...]):
    """The least letters among the cheapest for one row, and the states they lead to.

    ``states`` can all be reached by the letters so far; ``costs`` are those behind the row.
    """
    letters = ""
    here = _before(symbol, 1, costs)
    while True:
        best = min(here[q] for q in states)
        found: dict[str, set[int]] = {}
        for letter, q, to, cost in _edits(symbol):
            if q in states and cost + costs[to] == best:
                found.setdefault(letter, set()).add(to)
        put_in = {
            STEPS[r][q] for r in "ua" for q in states if q in STEPS[r]
            and INSERT + here[STEPS[r][q]] == best
        }
        if "D" in found:
            return letters + "D", tuple(sorted(found["D"]))
        if put_in:
            letters, states = letters + "I", tuple(sorted(put_in))
            continue
        letter = min(found)
        return letters + letter, tuple(sorted(found[letter]))


def _unroll(symbol: str, n: int, states, costs, out: list[str]):
    """Append the letters of a run and return the states behind it."""
    if n == 1:
        letters, states = _choose(symbol, states, costs)
        out.append(letters)
        return states
    half = n // 2
    states = _unroll(symbol, n - half, states, _before(symbol, half, costs), out)
    return _unroll(symbol, half, states, costs, out)


Runs = list[tuple[str, int]]


def _costs_between(runs: Runs, costs: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to the end from before each run, and from behind the last."""
    out = [costs]
    for symbol, n in reversed(runs):
        out.append(_before(symbol, n, out[-1]))
    return out[::-1]


def cheapest(runs: Runs, start: int = START, end: int | None = None) -> tuple[int, str]:
    """Least cost and least letters from ``start`` to ``end``, or to the conversation's end."""
    goal = END_COSTS if end is None else tuple(0 if q == end else FAR for q in STATES)
    costs = _costs_between(runs, goal)
    if costs[0][start] >= FAR:
        return FAR, ""
    letters: list[str] = []
    states = (start,)
    for (symbol, n), behind in zip(runs, costs[1:]):
        states = _unroll(symbol, n, states, behind, letters)
    if end is None:
        letters.append("I" * CLOSING[states[0]])
    return costs[0][start], "".join(letters)


# ---- blocks


class _Summary:
    """Counts and runs of a stretch of one conversation."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_role = self.last_role = ""
        self.low = self.high = None
        self.turns = 0
        self.runs: Runs = []

    def add(self, turn, copies, initial, blank, cut, first) -> None:
        if copies == 0:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        out_of_place = initial + initial not in LEGAL_PAIRS
        if self.last_role:
            self.illegal += self.last_role + initial not in LEGAL_PAIRS
        self.illegal += out_of_place * (copies - 1)
        # an empty role has no initial: a mark that no role starts with stands for it
        self.first_role = self.first_role or initial or "\0"
        self.last_role = initial or "\0"
        kept = 0
        if blank:
            self.blank += copies
        else:
            kept = int(first)
            self.duplicate += copies - kept
            self.truncated += kept and cut
        if kept:
            symbol = initial if initial in ("s", "u", "a") else "o"
            self._run(symbol.upper() if cut else symbol, 1)
        if copies > kept:
            self._run(GONE, copies - kept)

    def _run(self, symbol: str, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            n += self.runs.pop()[1]
        self.runs.append((symbol, n))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


PART = (
    "conv_id long, block long, blank long, duplicate long, truncated long, illegal long,"
    " first_role string, last_role string, low long, high long, turns long,"
    " costs array<long>, ranks array<int>, gaps long, cost long, audit string"
)
_PART_NAMES = [field.split()[0] for field in PART.split(", ")]
_PART_KINDS = {
    "long": pa.int64(), "string": pa.string(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}
_PART_SCHEMA = pa.schema([(f.split()[0], _PART_KINDS[f.split()[1]]) for f in PART.split(", ")])


def _conversations(table: pa.Table) -> Iterator[tuple[int | None, list[tuple]]]:
    rows = table.sort_by("at")
    names = ("conv_id", "turn", "copies", "initial", "blank", "cut", "first")
    columns = [rows[name].to_pylist() for name in names]
    for conv_id, group in groupby(zip(*columns), key=lambda row: row[0]):
        yield conv_id, [row[1:] for row in group]


def _summary(rows: list[tuple]) -> _Summary:
    out = _Summary()
    for row in rows:
        out.add(*row)
    return out


def _path_tables(runs: Runs) -> tuple[list[int], list[int]]:
    """Cost from each state to each, and the rank of its letters among the 16."""
    found = [cheapest(runs, q, end) for q in STATES for end in STATES]
    order = {letters: i for i, letters in enumerate(sorted({text for _, text in found}))}
    return [cost for cost, _ in found], [order[text] for _, text in found]


def _block_parts(table: pa.Table) -> pa.Table:
    """What each conversation of a block comes to; those at its edges may go on elsewhere."""
    block = table["block"][0].as_py()
    found = [(conv_id, _summary(rows)) for conv_id, rows in _conversations(table)]
    out = []
    for i, (conv_id, s) in enumerate(found):
        row = dict.fromkeys(_PART_NAMES) | {"conv_id": conv_id, "block": block}
        row |= {k: int(getattr(s, k)) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        row |= {k: getattr(s, k) for k in ("first_role", "last_role", "low", "high")}
        if 0 < i < len(found) - 1:
            row["gaps"] = s.gaps()
            row["cost"], row["audit"] = cheapest(s.runs)
        else:
            row["costs"], row["ranks"] = _path_tables(s.runs)
        out.append(row)
    return pa.Table.from_pylist(out, _PART_SCHEMA)


PATH = "conv_id long, block long, start int, end int"
_PATH_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
)


def _paths(table: pa.Table) -> pa.Table:
    """From which state to which each block of a conversation goes, in the cheapest edits."""
    table = table.sort_by("block")
    costs, ranks = table["costs"].to_pylist(), table["ranks"].to_pylist()
    behind = list(zip(END_COSTS, END_RANKS))
    turns = []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        best = [
            min(
                (cost[4 * q + e] + behind[e][0], rank[4 * q + e], behind[e][1], e)
                for e in STATES
            )
            for q in STATES
        ]
        turns.append([b[3] for b in best])
        order = {key: i for i, key in enumerate(sorted({b[1:3] for b in best}))}
        behind = [(min(b[0], FAR), order[b[1:3]]) for b in best]
    out, state = [], START
    for conv_id, block, turn in zip(
        table["conv_id"].to_pylist(), table["block"].to_pylist(), reversed(turns)
    ):
        out.append({"conv_id": conv_id, "block": block, "start": state, "end": turn[state]})
        state = turn[state]
    return pa.Table.from_pylist(out, _PATH_SCHEMA)


PIECE = "conv_id long, block long, cost long, audit string"
_PIECE_SCHEMA = pa.schema([f for f in _PART_SCHEMA if f.name in ("conv_id", "block", "cost", "audit")])


def _block_pieces(rows: pa.Table, paths: pa.Table) -> pa.Table:
    """The edits of the conversations that cross this block."""
    wanted = {p["conv_id"]: (p["block"], p["start"], p["end"]) for p in paths.to_pylist()}
    out = []
    for conv_id, group in _conversations(rows) if wanted else ():
        if conv_id in wanted:
            block, start, end = wanted[conv_id]
            cost, audit = cheapest(_summary(group).runs, start, end)
            out.append({"conv_id": conv_id, "block": block, "cost": cost, "audit": audit})
    return pa.Table.from_pylist(out, _PIECE_SCHEMA)


def _joined_parts(parts: DataFrame, pieces: DataFrame, paths: DataFrame) -> DataFrame:
    """The report of the conversations at the edges of blocks, from their parts."""
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("conv_id", "block")]
    edits = pieces.alias("a").join(
        paths.select("conv_id", "block", "end").alias("p"), same[0] & same[1]
    ).select("a.conv_id", "a.block", "cost", "audit", "end")
    rows = parts.alias("p").join(edits.alias("a"), same[0] & same[1]).select(
        "p.conv_id",
        F.struct(
            "p.block", "first_role", "last_role", "low", "high", "turns", "illegal",
            "a.audit", "a.end",
        ).alias("part"),
        "blank", "duplicate", "truncated", "a.cost",
    )
    # one entry for BLOCK rows of a conversation
    listed = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")],
    )
    spoken = F.filter("parts", lambda p: p["first_role"] != "")
    timed = F.filter("parts", lambda p: p["low"].isNotNull())

    def touching(parts: Column, test) -> Column:
        """Neighbours among the parts for which the test holds."""
        pairs = F.arrays_zip(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"),
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("b"),
        )
        return F.size(F.filter(pairs, lambda p: test(p["a"], p["b"]))).cast("long")

    def added(name: str) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p[name])

    breaks = touching(
        spoken, lambda a, b: ~F.concat(a["last_role"], b["first_role"]).isin(*LEGAL_PAIRS)
    )
    shared = touching(timed, lambda a, b: a["high"] == b["low"])
    end = F.element_at("parts", -1)["end"]
    closing = F.when(end == SYSTEM, 2).when(end == USER, 1).otherwise(0)
    low = F.array_min(F.transform("parts", lambda p: p["low"]))
    high = F.array_max(F.transform("parts", lambda p: p["high"]))
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "")
    return listed.select(
        "conv_id",
        F.coalesce(high - low + 1 - (added("turns") - shared), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated",
        (added("illegal") + breaks).alias("illegal"),
        (F.col("cost") + INSERT * closing).alias("cost"),
        F.concat(audit, F.repeat(F.lit("I"), closing)).alias("audit"),
    )


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cost and edits of every conversation: the columns of ``REPORT``."""
    return _report(_plain(rows), block)


def _report(plain: DataFrame, block: int) -> DataFrame:
    blocks = _blocks(_symbols(plain), block)
    parts = materialized(
        blocks.groupBy("block").applyInArrow(_block_parts, PART), "conversation-parts"
    )
    edges = parts.filter(F.col("audit").isNull())
    paths = materialized(
        edges.select("conv_id", "block", "costs", "ranks")
        .groupBy("conv_id").applyInArrow(_paths, PATH),
        "conversation-paths",
    )
    pieces = (
        blocks.groupBy("block").cogroup(paths.groupBy("block"))
        .applyInArrow(_block_pieces, PIECE)
    )
    names = [field.split()[0] for field in REPORT.split(", ")]
    inside = parts.filter(F.col("audit").isNotNull()).select(*names)
    return inside.unionByName(_joined_parts(edges, pieces, paths).select(*names))


# ---- texts


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(report, None) for a conversation, then (None, (place, edit, role, text)) for its turns.

    ``rows`` are sorted: a conversation's report comes first, then its texts in order. Only the
    edits of the present conversation are held.
    """
    audit, at, place, odd = "", 0, 0, 0

    def expected() -> str:
        return "assistant" if (place - odd) % 2 else "user"

    for *head, role, text, copies in rows:
        if copies is None:  # the report of the next conversation
            while at < len(audit):
                yield None, (place, "I", expected(), "")
                at, place = at + 1, place + 1
            yield tuple(head), None
            audit, at, place = head[-1], 0, 0
            odd = (len(audit) - audit.count("D")) % 2
            continue
        for _ in range(copies):
            while audit[at] == "I":
                yield None, (place, "I", expected(), "")
                at, place = at + 1, place + 1
            edit, at = audit[at], at + 1
            if edit != "D":
                yield None, (place, edit, role if edit == "K" else expected(), text)
                place += 1
    while at < len(audit):
        yield None, (place, "I", expected(), "")
        at, place = at + 1, place + 1


_REPORT_NAMES = [field.split()[0] for field in REPORT.split(", ")]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in [*_REPORT_NAMES, "role", "text", "copies"]))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, pa.string() if n == "audit" else pa.int64()) for n in _REPORT_NAMES]
        + [("repaired_sha256", pa.string())]
    )
    done, now, digest = [], None, None

    def packed():
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for head, turn in _edited(_stream(batches)):
        if head is not None:
            if now is not None:
                done.append((*now, digest.hexdigest()))
            now, digest = head, hashlib.sha256()
            if len(done) >= 1000:
                yield packed()
                done = []
            continue
        place, _, role, text = turn
        digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
    if now is not None:
        done.append((*now, digest.hexdigest()))
    if done:
        yield packed()


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, conv_id = [], None
    for head, turn in _edited(_stream(batches)):
        if head is not None:
            conv_id = head[0]
            continue
        out.append((conv_id, *turn))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _in_order(rows: DataFrame, block: int) -> DataFrame:
    """Reports and texts, sorted by conversation; the only time that texts are shuffled.

    A conversation's turns come to one task, as a hash over all of them in order needs, but as
    a stream from a sort that spills, not as a group.
    """
    plain = _plain(rows)
    texts = plain.filter("copies > 0")
    heads = _report(plain, block)
    return (
        heads.unionByName(texts, allowMissingColumns=True)
        .withColumn("_is_text", F.col("copies").isNotNull())
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "_is_text", "turn", "digest")
        .select(*_REPORT_NAMES, "role", "text", "copies")
    )


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of the repaired conversations: place, edit (K, R or I), role and text."""
    return _in_order(rows, block).mapInArrow(_turn_batches, REPAIRED)


def repair_digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The report of every conversation and the SHA-256 of its repaired turns."""
    return _in_order(rows, block).mapInArrow(_digest_batches, DIGEST)
