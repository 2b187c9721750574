"""Repair of conversation structure at the least cost (operator 11).

Rows are damaged by a checksum of their ids, so that there is something to repair; then each conversation is
edited until its roles read (system)? (user assistant)+, or nothing is left. Edits: Keep 0, Rerole 3, Delete 4 (the
only one for blank and duplicate rows), Insert of an empty turn 3; a truncated row that is not deleted adds 3.
Of the cheapest repairs the one whose audit, the letters D I K R of its edits in order, is least in ASCII.

Each edge of a DAG weighs one big integer: its high digits are the cost, its low digits the letters of a
row's slot, at most two inserts and the row's own edit, in a fixed place of the row and filled up with zeros. A
slot ends with the one letter that is no insert, so no slot begins another, and sums of weights compare as the
audits do. The least sum from the first row to the last decides cost and audit at once.

Conversations of at most `limit` rows are solved one by one within sorted partitions. Longer ones are cut into blocks
of that many rows: a block is the matrix of its least weights between states, blocks are folded in order, and
each block then writes its own repaired rows. Equal rows of a turn are one row with a count. What meets in one
task for a long conversation is its audit, which the result holds in one row, and, one row at a time, the
repaired texts for their hash, which SHA-256 can only take in order.

Nulls and edge cases: a null role or text is one space, as is a null id in the checksum; rows of equal turns are
in the order of role and text; a role's initial is its first character as it stands, and an empty role
has none and is never kept; a null conv_id is a conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

START, SYSTEM, USER, ASSISTANT, END = range(5)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = " DIKR"  # a letter's place is its digit
DIGIT, SLOT = 3, 3  # bits of a digit, letters of a slot
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?")


def _follow(state: int) -> tuple[int, ...]:
    """The state after one insert, which is the one turn that may follow."""
    return tuple(NEXT[state, c] for c in "ua" if (state, c) in NEXT)


def _slot(letters: str) -> int:
    """Letters as digits from the left, zeros to the end."""
    return sum(LETTERS.index(c) << DIGIT * (SLOT - 1 - i) for i, c in enumerate(letters))


def _moves(initial: str, forced: bool, truncated: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, slot) of a row, the least of each two states. Two inserts lead back to where one could be left out."""
    least: dict[tuple[int, int], tuple[int, int]] = {}
    more = TRUNCATED * truncated
    for begin in (START, SYSTEM, USER, ASSISTANT):
        at = [(begin, "")]
        for _ in range(2):
            at += [(t, at[-1][1] + "I") for t in _follow(at[-1][0])[:1]]
        for state, inserts in at:
            edits = [(state, DELETE, "D")]
            if not forced:
                edits += [(t, RENAME + more, "R") for t in _follow(state)]
                if (state, initial) in NEXT:
                    edits.append((NEXT[state, initial], more, "K"))
            for t, cost, letter in edits:
                found = (cost + INSERT * len(inserts), _slot(inserts + letter))
                least[begin, t] = min(found, least.get((begin, t), found))
    return tuple((s, t, c, x) for (s, t), (c, x) in sorted(least.items()))


#: Moves of every kind of row, and of the end of a conversation.
KINDS = {(i, f, t): _moves(i, f, t) for i in ("s", "u", "a", "") for f, t in ((False, False), (False, True), (True, False))}
TAIL = ((START, END, 0, _slot("")), (SYSTEM, END, 2 * INSERT, _slot("II")), (USER, END, INSERT, _slot("I")), (ASSISTANT, END, 0, _slot("")))


@dataclass
class Part:
    """Rows of a conversation in order, as what decides about them."""

    slots: list[tuple] = field(default_factory=list)  # moves of each row that has a choice or not
    copies: list[int] = field(default_factory=list)  # rows deleted behind each slot, which are its duplicates
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None

    def add(self, role: str, text: str, n: int, is_new: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.illegal += n - 1  # equal roles never follow each other
        bare = text.rstrip(_SPACE)
        forced = not bare or not is_new
        cut = bool(bare) and is_new and not bare.endswith(_ENDS)
        if not bare:
            self.blank += n
        else:
            self.duplicate += n - is_new
            self.truncated += cut
        self.slots.append(KINDS[initial if initial in ("s", "u", "a") else "", forced, cut])
        self.copies.append(n - 1)


def least_paths(slots: list[tuple], start: int) -> dict[int, tuple[int, int]]:
    """{state: (cost, digits of the slots)} of the least weights from a state through all slots."""
    width = DIGIT * SLOT
    total = width * len(slots)
    sums = {start: 0}
    for i, moves in enumerate(slots, 1):
        place, new = total - width * i, {}
        for s, t, cost, slot in moves:
            if s in sums:
                weight = sums[s] + (cost << total) + (slot << place)
                if t not in new or weight < new[t]:
                    new[t] = weight
        sums = new
    low = (1 << total) - 1
    return {t: (v >> total, v & low) for t, v in sums.items()}


def letters_of(digits: int, n_slots: int) -> list[str]:
    """The letters of each slot."""
    raw = oct(digits)[2:].rjust(SLOT * n_slots, "0")
    return ["".join(LETTERS[int(c)] for c in raw[i : i + SLOT] if c != "0") for i in range(0, len(raw), SLOT)]


def audit_of(slots: list[str], copies: list[int]) -> str:
    return "".join(s + "D" * n for s, n in zip(slots, copies, strict=True))


def rewrite(rows: list[tuple[str, str]], slots: list[str], state: int) -> Iterator[str]:
    """`role:text` of the repaired rows; slots beyond the rows are inserts at the end."""
    for i, letters in enumerate(slots):
        for c in letters:
            if c == "D":
                continue
            if c == "K":
                state = NEXT[state, rows[i][0][:1]]
                yield f"{rows[i][0]}:{rows[i][1]}"
            else:
                state = _follow(state)[0]
                yield f"{ROLE[state]}:{rows[i][1] if c == 'R' else ''}"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (how often): every row but those that are dropped, of which a row with a null
    role and n 0 tells that the conversation was there."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    n = F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return c.withColumn("kind", kind).select("conv_id", *[F.when(~gone, x).alias(a) for x, a in ((F.col("turn"), "turn"), (role, "role"), (text, "text"))], n.alias("n"))


_FIELDS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
_RESULT = ", ".join(["conv_id long", *(f"{k} {v}" for k, v in _FIELDS.items())])
_ARROW = pa.schema([("conv_id", pa.int64()), *((k, pa.int64() if v == "long" else pa.string()) for k, v in _FIELDS.items())])
_ORDER = ("conv_id", "turn", "role", "text")


def _gaps(turns: set) -> int:
    known = turns - {None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _solved(conv_id: int | None, rows: list[tuple]) -> dict:
    """A whole conversation; rows: (turn, role, text, n) in order."""
    part, seen, kept, turns = Part(), set(), [], set()
    for turn, role, text, n in rows:
        part.add(role, text, n, (role, text) not in seen)
        seen.add((role, text))
        kept.append((role, text))
        turns.add(turn)
    cost, digits = least_paths([*part.slots, TAIL], START)[END]
    slots = letters_of(digits, len(kept) + 1)
    repaired = "\n".join(rewrite(kept, slots, START))
    return {"conv_id": conv_id, "gaps": _gaps(turns), "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated, "illegal": part.illegal, "cost": cost + DELETE * sum(part.copies),
            "audit": audit_of(slots, [*part.copies, 0]), "repaired_sha256": hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest()}


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of a few rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conv, out = [], None, []
        begun = False
        for batch in batches:
            for conv_id, turn, role, text, n in zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "n")), strict=True):
                if begun and conv_id != conv:
                    out.append(_solved(conv, own))
                    own = []
                conv, begun = conv_id, True
                if role is not None:
                    own.append((turn, role, text, n))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
        if begun:
            yield pa.RecordBatch.from_pylist([_solved(conv, own)], schema=_ARROW)

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "conv_id")
    return dealt.sortWithinPartitions(*[F.asc_nulls_first(c) for c in _ORDER]).mapInArrow(run, _RESULT)


def _long(rows: DataFrame, limit: int) -> DataFrame:
    """Conversations of any length, in blocks of `limit` rows."""
    spark = rows.sparkSession
    merged = rows.groupBy(*_ORDER).agg(F.sum("n").alias("n"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = merged.withColumn("said", said).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    first = marked.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("at").alias("first"))
    joined = marked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("said").eqNullSafe(F.col("s")))
    new = joined.select(*_ORDER, "n", F.col("at").eqNullSafe(F.col("first")).alias("is_new"))
    order = [F.asc_nulls_first(c) for c in _ORDER]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, i = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            at = [base + (i + k) // limit for k in range(batch.num_rows)]
            i += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "block"])

    dealt = new.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    own = materialize(dealt.mapInArrow(number, "conv_id long, turn long, role string, text string, n long, is_new boolean, block long"), "repair")
    # A conversation without rows after damage has one row with a null role, in its first block.
    states = range(4)

    def ordered(table: pa.Table) -> list[dict]:
        rows = [r for r in table.to_pylist() if r["role"] is not None]
        return sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode("utf-8", "surrogatepass"), r["text"].encode("utf-8", "surrogatepass")))

    def matrix(key: tuple, table: pa.Table) -> pa.Table:
        part = Part()
        for r in ordered(table):
            part.add(r["role"], r["text"], r["n"], r["is_new"])
        paths = []
        for s in states:
            for t, (cost, digits) in least_paths(part.slots, s).items():
                slots = letters_of(digits, len(part.slots)) if part.slots else []
                paths.append({"begin": s, "end": t, "cost": cost, "slots": ",".join(slots), "audit": audit_of(slots, part.copies)})
        # The duplicates behind each slot are deleted on every path.
        row = {"conv_id": key[0].as_py(), "block": key[1].as_py(), "paths": paths, "n": len(part.slots), "more": DELETE * sum(part.copies)}
        return pa.Table.from_pylist([row | {k: getattr(part, k) for k in ("blank", "duplicate", "truncated", "illegal", "first", "last")}], schema=matrix_schema)

    path_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("slots", pa.string()), ("audit", pa.string())]))
    counts = ("blank", "duplicate", "truncated", "illegal")
    matrix_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("paths", path_type), ("n", pa.int64()), ("more", pa.int64()), *((c, pa.int64()) for c in counts), ("first", pa.string()), ("last", pa.string())])
    matrices = materialize(own.groupBy("conv_id", "block").applyInArrow(
        matrix, "conv_id long, block long, paths array<struct<begin:int,end:int,cost:long,slots:string,audit:string>>, n long, more long, "
        + ", ".join(f"{c} long" for c in counts) + ", first string, last string"), "repair-blocks")

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        blocks = [b for b in sorted(table.to_pylist(), key=lambda b: b["block"]) if b["n"]]
        best = {s: (c, LETTERS[2] * (c // INSERT), None) for s, _, c, _ in TAIL}  # from a state to the end
        choices: list[dict[int, dict]] = []
        for b in reversed(blocks):
            here: dict[int, tuple] = {}
            for p in b["paths"]:
                cost, audit, _ = best[p["end"]]
                found = (p["cost"] + cost, p["audit"] + audit, p)
                if p["begin"] not in here or found[:2] < here[p["begin"]][:2]:
                    here[p["begin"]] = found
            best = here
            choices.append({s: f[2] for s, f in here.items()})
        sums = {c: sum(b[c] for b in blocks) for c in counts}
        for a, b in zip(blocks, blocks[1:], strict=False):
            sums["illegal"] += a["last"] + b["first"] not in LEGAL
        cost, audit, _ = best[START]
        out, state = [], START
        for b, chosen in zip(blocks, reversed(choices), strict=True):
            out.append({"block": b["block"], "state": state, "slots": chosen[state]["slots"]})
            state = chosen[state]["end"]
        if out:
            out[-1]["slots"] += "," + LETTERS[2] * next(c // INSERT for s, _, c, _ in TAIL if s == state)
        return pa.Table.from_pylist([{"conv_id": key[0].as_py(), "cost": cost + sum(b["more"] for b in blocks), "audit": audit, "chosen": out, **sums}], schema=fold_schema)

    chosen_type = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("slots", pa.string())]))
    fold_schema = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("chosen", chosen_type), *((c, pa.int64()) for c in counts)])
    folded = materialize(matrices.groupBy("conv_id").applyInArrow(
        fold, "conv_id long, cost long, audit string, chosen array<struct<block:long,state:int,slots:string>>, " + ", ".join(f"{c} long" for c in counts)), "repair-folded")

    def write(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chosen = right.to_pylist()
        pieces = list(rewrite([(r["role"], r["text"]) for r in ordered(left)], chosen[0]["slots"].split(","), chosen[0]["state"])) if chosen else []
        return pa.table([pa.array([key[0].as_py()] * len(pieces), pa.int64()), pa.array([key[1].as_py()] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())],
                        ["conv_id", "block", "place", "piece"])

    picked = folded.select("conv_id", F.explode("chosen").alias("x")).select("conv_id", "x.*")
    pieces = own.groupBy("conv_id", "block").cogroup(picked.groupBy("conv_id", "block")).applyInArrow(write, "conv_id long, block long, place long, piece string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            done = []
            for conv_id, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if sha is not None and conv_id == conv:
                    sha.update(b"\n")
                else:
                    done += [(conv, sha.hexdigest())] if sha is not None else []
                    conv, sha = conv_id, hashlib.sha256()
                sha.update(piece.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    hashes = pieces.repartition(shuffle_width(spark), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block", "place").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    turns = own.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long")).alias("gaps"))
    hashes = hashes.withColumnRenamed("conv_id", "h")
    joined = folded.join(turns, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *[F.coalesce("repaired_sha256", nothing).alias(c) if c == "repaired_sha256" else F.col(c) for c in _FIELDS])


def repair(conversations: DataFrame, limit: int = 512) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage.
    limit: rows that a task solves as one; longer conversations go in blocks, with the same result."""
    rows = damage(conversations)
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > limit).select("long_id")
    # At most one row for each `limit` rows of the table.
    sizes = materialize(sizes, "repair-long")
    if sizes.isEmpty():
        return _short(rows)
    met = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(sizes, met, "left_anti")).unionByName(_long(rows.join(sizes, met, "left_semi"), limit))


ORACLE = r"""
    WITH RECURSIVE c AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
    ), k AS (
        SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda x: [CAST(unicode(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                                  lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 20 AS kind FROM c
    ), d AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM k WHERE kind <> 0
    ), n AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d
    ), f AS (
        SELECT *, left(role, 1) AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
        FROM n
    ), pairs AS (
        SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f
    ), next(s, initial, t) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), follow AS (
        SELECT s, t, CASE t WHEN 2 THEN 'user' ELSE 'assistant' END AS role FROM next WHERE initial <> 's'
    ), ins AS (
        SELECT DISTINCT s, s AS t, '' AS letters, '' AS made, 0 AS cost FROM next
        UNION ALL SELECT s, t, 'I', role || ':' || chr(10), 3 FROM follow
        UNION ALL SELECT a.s, b.t, 'II', a.role || ':' || chr(10) || b.role || ':' || chr(10), 6 FROM follow a JOIN follow b ON a.t = b.s
    ), edit AS (
        SELECT DISTINCT s, s AS t, 'D' AS letter, '' AS initial, '' AS role, 4 AS cost FROM next
        UNION ALL SELECT s, t, 'R', '', role, 3 FROM follow
        UNION ALL SELECT s, t, 'K', initial, '', 0 FROM next
    ), move AS (
        SELECT i.s, e.t, i.letters || e.letter AS letters, i.made, i.cost + e.cost AS cost, e.letter, e.initial, e.role FROM ins i JOIN edit e ON i.t = e.s
    ), dp AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': 0, 'audit': '', 'made': ''} AS v FROM f
        UNION ALL
        SELECT dp.conv_id, f.i, m.t, min({'cost': dp.v.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': dp.v.audit || m.letters,
                                          'made': dp.v.made || m.made || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE m.role || ':' || f.text || chr(10) END})
        FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
        JOIN move m ON m.s = dp.s AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (m.letter <> 'K' OR m.initial = f.initial)
        GROUP BY dp.conv_id, f.i, m.t
    ), done AS (
        SELECT dp.conv_id, min({'cost': v.cost + i.cost, 'audit': v.audit || i.letters, 'made': v.made || i.made}) AS v
        FROM dp JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.n = dp.i
        JOIN ins i ON i.s = dp.s AND (i.t = 3 OR (i.s = 0 AND i.t = 0)) GROUP BY dp.conv_id
    ), faults AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id
    ), bad AS (
        SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(done.v.cost, 0) AS BIGINT) AS cost, coalesce(done.v.audit, '') AS audit,
           sha256(CASE WHEN coalesce(done.v.made, '') = '' THEN '' ELSE left(done.v.made, length(done.v.made) - 1) END) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
