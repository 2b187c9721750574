"""Replacement on disk, digests, identities, merged outputs and prompt batches on small tables."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import catalog, evaluate, knowledge


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_replace_on_disk(spark, tmp_path):
    path, first = f"{tmp_path}/t", [(k, f"{k}.{i}") for k in range(40) for i in range(k % 3 + 1)]
    catalog.write_bucketed(table(spark, first), path, "k", 8)
    before = files(path)
    keys, new = spark.createDataFrame([(3,), (5,), (77,)], "k long"), [(3, "new"), (77, "more")]
    touched = {r[0] for r in keys.select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    want = sorted([r for r in first if r[0] not in (3, 5)] + new)
    for _ in range(2):  # again is the same
        assert sorted(map(tuple, catalog.replace_on_disk(path, table(spark, new), keys, "k", 8).collect())) == want
    after = files(path)
    quiet = {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert quiet and {f: before[f] for f in quiet} == {f: after[f] for f in after if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    with pytest.raises(ValueError):
        catalog.replace_on_disk(path, table(spark, [(4, "x")]), keys, "k", 8)
    assert files(path) == after


def test_replace_on_disk_empties_a_folder(spark, tmp_path):
    path = f"{tmp_path}/t"
    catalog.write_bucketed(table(spark, [(1, "a"), (2, "b")]), path, "k", 64)
    left = catalog.replace_on_disk(path, table(spark, []), spark.createDataFrame([(1,)], "k long"), "k", 64)
    assert [tuple(r) for r in left.collect()] == [(2, "b")] and len(glob.glob(f"{path}/_bucket=*")) == 1
    assert catalog.replace_on_disk(path, table(spark, []), spark.createDataFrame([], "k long"), "k", 64).count() == 1


def test_digest_is_of_the_rows_alone(spark):
    rows = [(i % 5, f"t{i % 7}") for i in range(60)] + [(None, None), (1, None)]
    whole = lambda r: evaluate.digest(table(spark, r).repartition(3), [], ["k", "v"]).first()
    base = whole(rows)
    shuffled = random.Random(1).sample(rows, len(rows))
    assert whole(shuffled) == base
    a, b = rows[:30], rows[30:]
    parts = evaluate.digest(table(spark, a), [], ["k", "v"]).unionByName(evaluate.digest(table(spark, b), [], ["k", "v"]))
    assert evaluate.add_digests(parts, []).first() == base
    for changed in (rows[1:], rows + rows[:1], rows[1:] + [(9, "t0")], rows[:-1] + [(None, "1")]):
        assert whole(changed) != base
        assert evaluate.same_digest(table(spark, rows), table(spark, changed)).first()["equal"] is False
    assert whole([(1, "a"), (1, "a")]) != whole([(1, "b"), (1, "b")])
    assert evaluate.same_digest(table(spark, rows), table(spark, shuffled)).first()["equal"] is True
    assert whole([])["n"] == 0 and evaluate.same_digest(table(spark, []), table(spark, [])).first()["equal"] is True


def test_canonical_json(spark):
    df = spark.createDataFrame([("a|b", "c", None), ("a", "b|c", None), ("a", None, "b"), ("a", "b", None), ('q"\n', "\\", "")], "x string, y string, z string")
    made = [r[0] for r in df.select(text.canonical_json(b=F.col("y"), a=F.col("x"), c=F.col("z"))).collect()]
    assert len(set(made)) == 5 and made[2] == '{"a":"a","b":null,"c":"b"}'
    assert [list(json.loads(m)) for m in made] == [["a", "b", "c"]] * 5


def test_json_length(spark):
    texts = ['a"b\\c', "\n\r\t\b\f", "\x00\x1f\x0b\x7f", "é😀漢/", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.json_length(F.col("t"))).collect()]
    assert got == [len(json.dumps(t, ensure_ascii=False)) - 2 for t in texts]


def test_merged_items(spark):
    rows = [(1, 0, 0, "concepts", '{"name":"abc x"}'), (1, 0, 1, "concepts", '{"name":"abc y"}'), (1, 1, 0, "concepts", '{"name":"abc x"}'), (1, 1, 1, "key_points", '{"name":"abc x"}')]
    rows += [(1, b, i, "questions", f'{{"q":{(b * 3 + i) % 8}}}') for b in range(4) for i in range(3)] + [(2, 0, 0, "questions", "{}")]
    got = knowledge.merge_items(spark.createDataFrame(rows, "doc_id long, batch int, pos int, category string, item string").repartition(4)).orderBy("doc_id", "category", "place").collect()
    of = lambda c, d=1: [r["item"] for r in got if r["category"] == c and r["doc_id"] == d]
    assert of("concepts") == ['{"name":"abc x"}', '{"name":"abc y"}'] and of("key_points") == ['{"name":"abc x"}']
    assert of("questions") == [f'{{"q":{i}}}' for i in range(5)] and of("questions", 2) == ["{}"]


def test_merged_texts(spark):
    rows = [(1, 2, "B", "two"), (1, 0, "A", ""), (1, 1, "A", "one"), (1, 3, "", "two"), (2, 0, "", "")]
    got = {r["doc_id"]: (r["topic"], r["overview"]) for r in knowledge.merge_texts(spark.createDataFrame(rows, "doc_id long, batch int, topic string, overview string")).collect()}
    assert got == {1: ("A\n\nB", "one\n\ntwo"), 2: ("", "")}


def brute_batches(rows, limit, most):
    def size(row, content):
        return len(json.dumps({"source_chunk_id": row[0], "resource_id": row[1], "page_number": row[2], "chunk_index": row[3], "content": content, "warnings": row[5] or [], "label": f"[CHUNK_ID={row[0]} | PAGE={'null' if row[2] is None else row[2]}]"}, ensure_ascii=False, separators=(",", ":")))

    def parts(row, content):
        if 13 + size(row, content) <= limit or len(content) < 2:
            return [content]
        return parts(row, content[: len(content) // 2]) + parts(row, content[len(content) // 2 :])

    out, batch, used = [], -1, 0
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        for k, content in enumerate(parts(row, row[4] or "")):
            n = size(row, content)
            if batch < 0 or used + 1 + n > limit:
                batch, used = batch + 1, 13 + n
            else:
                used += 1 + n
            out.append((batch, row[3], k, len(content), n))
    return sorted((*r, batch + 1 > most) for r in out)


def test_prompt_batches_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for d in range(6):
        for i in range(rng.randint(1, 9)):
            body = "".join(rng.choice('ab "\\\n\x01é漢😀') for _ in range(rng.choice([0, 1, 30, 90, 400, 1500])))
            rows.append((100 * d + i, d, rng.choice([None, 3]), i, rng.choice([body, body, None]), rng.choice([None, [], ['w "x"']])))
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, page_number int, chunk_index int, content string, warnings array<string>")
    for limit, most in ((400, 20), (150, 3), (90, 20)):
        got = {}
        for r in knowledge.prompt_batches(df, limit, most).collect():
            got.setdefault(r["doc_id"], []).append((r["batch"], r["chunk_index"], r["part"], r["n_chars"], r["n_json"], r["too_many"]))
        assert {d: sorted(v) for d, v in got.items()} == {d: brute_batches([r for r in rows if r[1] == d], limit, most) for d in range(6)}
    assert knowledge.prompt_batches(df.limit(0)).count() == 0
