"""Conversation repair against a plain search over (cost, edits) and a plain walk over the rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from steerframe.llm import catalog, conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged_rows(rows):
    """Rows after damage as (conv_id, turn, role, text), in order."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv_id, turn, role, text)] * (2 if kind == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def by_brute_force(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows."""
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append(
            "blank" if not bare else "duplicate" if (role, text) in seen
            else "truncated" if bare[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def put_in(paths):
        for _ in range(3):
            for q, (cost, edits, turns) in list(paths.items()):
                for role in ("user", "assistant"):
                    to = NEXT.get((q, role[0]))
                    if to:
                        offer(paths, to, (cost + 3, edits + "I", [*turns, f"{role}:"]))

    def offer(paths, q, path):
        if q not in paths or path[:2] < paths[q][:2]:
            paths[q] = path

    paths = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        put_in(paths)
        after = {}
        more = 3 if fault == "truncated" else 0
        for q, (cost, edits, turns) in paths.items():
            offer(after, q, (cost + 4, edits + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            to = NEXT.get((q, role[:1]))
            if to:
                offer(after, to, (cost + more, edits + "K", [*turns, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                to = NEXT.get((q, name[0]))
                if to:
                    offer(after, to, (cost + 3 + more, edits + "R", [*turns, f"{name}:{text}"]))
        paths = after
    put_in(paths)
    cost, audit, turns = min((paths[q] for q in ("", "a") if q in paths), key=lambda p: p[:2])
    count = faults.count
    return (
        gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
        hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    )


def expected(rows):
    left = {}
    for row in damaged_rows(rows):
        left.setdefault(row[0], []).append(row)
    return {c: by_brute_force(left.get(c, [])) for c in {r[0] for r in rows}}


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    rows = []
    for conv_id in [None, *range(60)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 40])):
            rows.append((
                conv_id,
                rng.choice([turn, turn, turn, 3, None]),
                rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                rng.choice(["Yes.", "No", "hm! ", "\n\t", "", "Fine?", "a b c", None, "é." * 9]),
            ))
    rows += [(100, 7, "user", "Same.")] * 30  # repeated rows of one turn
    rows += [(101, t, "user", "Hello") for t in range(25)]  # a long run
    rows += [(102, 0, "user", "word. " * 20_000 + "end")]  # a very long text
    return rows


@pytest.mark.parametrize("block", [3, 8192])
def test_repair_equals_brute_force(spark, talk, block):
    rows = [(*row, "clash") for row in talk]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(cr.repair_digests(cr.damage(df), block)) == expected(talk)


def test_repair_of_the_corpus_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.QUERIES["op13_conversation_repair"](spark, sf)) == expected(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = cr.repaired(df).orderBy("conv_id", "place").collect()
    # putting a reply in twice costs 6, giving the second row another role 3
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in turns] == [
        (1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again.")]
    assert cr.repair_digests(df.limit(0)).count() == 0


def test_runs_unroll_like_single_rows():
    rng = random.Random(5)
    for _ in range(300):
        runs = [(rng.choice("suaoUAx"), rng.choice([1, 1, 2, 7])) for _ in range(rng.randint(0, 5))]
        single = [(symbol, 1) for symbol, n in runs for _ in range(n)]
        assert cr.cheapest(runs) == cr.cheapest(single)
    cost, audit = cr.cheapest([("u", 100_000)])
    assert len(audit) == 100_000 and cost == 150_000
