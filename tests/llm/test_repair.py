"""Conversation repair against an exhaustive search, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """(turn, role, text) of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if bare[-1] not in ".!?" else "")
    return out


def all_repairs(rows):
    """Every way to edit a few rows, as (cost, audit, repaired rows)."""
    kinds = faults(rows)
    inserts = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    steps = []
    for (_, role, text), fault in zip(rows, kinds, strict=True):
        edits = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            edits += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        steps.append([(3 * len(i) + c, "I" * len(i) + a, [(r, "") for r in i] + o) for i in inserts for c, a, o in edits])
    steps.append([(3 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts])
    for way in itertools.product(*steps):
        made = [x for w in way for x in w[2]]
        if all(r for r, _ in made) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made)):
            yield sum(w[0] for w in way), "".join(w[1] for w in way), made


def least_repair(rows):
    """The same over the states of the grammar, for more rows, with audits as strings."""
    best = {"": (0, "", [])}
    step = lambda s, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(c)
    names = {"u": "user", "a": "assistant"}

    def insert(at):
        for _ in range(2):
            for s, (c, a, o) in list(at.items()):
                for x in "ua":
                    if t := step(s, x):
                        found = (c + 3, a + "I", [*o, (names[x], "")])
                        at[t] = min(at.get(t, found), found)
        return at

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        # Inserts are told apart by all beginnings, as a shorter one is not always better.
        for s0, v in best.items():
            ways = {(s0, ""): v}
            for k in (1, 2):
                for (s, i), (c, a, o) in list(ways.items()):
                    if len(i) == k - 1:
                        for x in "ua":
                            if t := step(s, x):
                                ways[t, i + "I"] = (c + 3, a + "I", [*o, (names[x], "")])
            for (s, _), (c, a, o) in ways.items():
                ends = [(s, 4, "D", [])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ends += [(step(s, x), 3 + more, "R", [(names[x], text)]) for x in "ua"] + [(step(s, role[:1]) if role else None, more, "K", [(role, text)])]
                for t, cost, letter, made in ends:
                    if t is not None:
                        found = (c + cost, a + letter, o + made)
                        new[t] = min(new.get(t, found), found)
        best = new
    done = {s: v for s, v in insert(best).items() if s in ("", "a")}
    return min(done.values())


def expected(rows, repair_of):
    own, kinds = rows, faults(rows)
    turns = {t for t, _, _ in own if t is not None}
    cost, audit, made = repair_of(own)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def conversations(seed, n, most, turns=None):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \n", "é?  ", "1", "Yes.", None, "漢字", "ok.\n\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "unit"]
    return [(c, rng.choice([t, t, t, t, t // 2, None]), rng.choice(roles[: 3 + c % 8]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, turns or most))]


def got(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [512, 1])
def test_small_conversations_equal_an_exhaustive_search(spark, limit):
    data = conversations(3, 60, 3)
    df = spark.createDataFrame(data, SCHEMA).withColumns({"block": F.lit(1), "n": F.lit("x"), "audit": F.lit(None).cast("string")})
    want = {c: expected(r, lambda rows: min(all_repairs(rows))) for c, r in damaged(data).items() if len(r) <= 3}
    found = got(repair.repair(df, limit=limit))
    assert {c: found[c] for c in want} == want
    assert len(want) > 40


@pytest.mark.parametrize("limit", [512, 7])
def test_long_and_null_conversations(spark, limit):
    data = conversations(5, 12, 40) + [(None, t, r, x) for _, t, r, x in conversations(6, 1, 60, 60)] + [(900, 1, "user", "same.")] * 50 + [(901, None, "user", "a."), (901, None, "assistant", "b.")]
    want = {c: expected(r, least_repair) for c, r in damaged(data).items()}
    assert got(repair.repair(spark.createDataFrame(data, SCHEMA).repartition(5), limit=limit)) == want


def test_conversation_without_rows_left(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = got(repair.repair(spark.createDataFrame([(7, turn, "user", "x")] * 3, SCHEMA), limit=2))
    assert rows == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(repair.repair(spark.createDataFrame([], SCHEMA))) == {}


def test_weights_of_long_paths_stay_exact():
    slots = [repair.KINDS["u", False, False]] * 5000
    cost, digits = repair.least_paths([*slots, repair.TAIL], repair.START)[repair.END]
    letters = "".join(repair.letters_of(digits, 5001))
    assert cost == 3 * 2500 and letters.count("R") == 2500


def test_query_covers_every_conversation(spark, sf_dir):
    found = got(queries.op11_repair(spark, sf_dir))
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == {c: expected(r, least_repair) for c, r in damaged(data).items()}
