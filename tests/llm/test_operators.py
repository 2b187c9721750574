"""Each numbered operator against brute force or an exact round trip, and its edge cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, fingerprints, html_extract, jaccard, labelled_pages, packing, perspectives, queries, shared, substrings, tokens, tokenstore, topk, toxicity, words
from tests.compare import connect, rows
from tests.llm import brute

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(alphabet=st.sampled_from("ab thé \n\t'sß12!?漢😀\x1c\x85́<|>"), max_size=60)


def near_copies(seed=5):
    """Groups of exact and near copies of several strengths, shared passages, one-word texts and edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out, k = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 250))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.1]) else w for w in base]
            out.append((k, rng.choice([" ", "\n", "  "]).join(copy)))
            k += 1
    out += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one two"), (k + 4, "One TWO"), (k + 5, "spam " * 300), (k + 6, "spam " * 100), (k + 7, "É one"), (k + 8, "é one")]
    return out


@pytest.fixture(scope="module")
def copies(spark):
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "shingle": F.lit(1), "n": F.lit(2), "rep": F.lit("x"), "window": F.lit(1)})
    return data, df


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_bpe_equals_library(text):
    own = bpe.codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    other = "Ab " + text[::-1]
    ids, counts = own.encode(pa.array([None, text, other, ""]))
    assert counts.tolist() == [0, len(library.encode_ordinary(text)), len(library.encode_ordinary(other)), 0]
    assert ids.tolist() == library.encode_ordinary(text) + library.encode_ordinary(other)
    ids = ids[: counts[1]]
    assert own.decode(ids) == text.encode()


def test_bpe_long_pieces():
    own = bpe.codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("a" * 3000, " " * 500, "ab" * 2000, "x\n" * 100):
        assert own.encode(pa.array([text]))[0].tolist() == library.encode_ordinary(text)


def test_remembered_chunks_stay_within_their_bound():
    own = bpe.codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    own.known.limit = own.pieces.known.limit = 20_000
    try:
        for k in range(30):  # white-space runs, many different words, some met again, and a long one
            text = " ".join(f"w{(k * 200 + j) % 1500}x{j}" for j in range(300)) + " \n  \t" * 50 + "y" * 500
            ids, counts = own.encode(pa.array([text, "a  b   c"]), end_id=7)
            want = [*library.encode_ordinary(text), 7]
            assert ids[: counts[0]].tolist() == want
            assert ids[counts[0] :].tolist() == [*library.encode_ordinary("a  b   c"), 7]
            assert own.known.strings.nbytes + 4 * len(own.known.flat) + 16 * len(own.known.sizes) <= 20_000
            assert max(map(len, own.known.strings.to_pylist())) <= 64
    finally:
        own.known.limit = own.pieces.known.limit = 32 << 20
    own.clear()
    assert not len(own.known.strings) and not len(own.pieces.known.strings)


def test_bpe_query(spark):
    df = spark.createDataFrame([(1, "Hello  wörld\n"), (2, None), (3, ""), (None, "x"), (1, "Hello  wörld\n")], "doc_id long, text string")
    got = bpe.digest(bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)).collect()
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["decoded_sha256"]) for r in got if r["doc_id"] in (2, 3)} == {(0, empty)}
    assert {r["decoded_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256("Hello  wörld\n".encode()).hexdigest()}
    assert bpe.digest(bpe.decode(bpe.encode(df.limit(0), RANKS, P.PATTERN), RANKS, P.PATTERN)).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXT)
@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cached_tokenizer_equals_library(name, drops, text):
    text += " Don't ÀÉ <|endoftext|> x"
    library = Tokenizer.from_file(P.path(name))
    ids, counts = tokens.encoder(P.path(name), drops).encode(pa.array([text, None, "  a   b", text]), end_id=0)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in (text, None, "  a   b", text)]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = tokenstore.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (tokenstore.unpack(packed, bits, 0, 1001) == ids).all()
    assert (tokenstore.unpack(packed, bits, 37, 500) == ids[37:537]).all()


def test_token_store_round_trip(spark, tmp_path):
    data = [(k, f"Text {k} " * (k % 40)) for k in range(300, 0, -1)] + [(301, None), (302, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(df, path, P.path("byte_bpe_50k.json"), block_tokens=1000)
    got = {r["doc_id"]: r for r in tokenstore.digest(tokenstore.read_store(spark, path)).collect()}
    library, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for k, text in sorted(data):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    blocks = spark.read.parquet(path).collect()
    assert len(blocks) > 4
    block = tokenstore.Block(blocks[0]["payload"])
    assert block.document(1).tolist() == [*library.encode(dict(data)[int(block.doc_ids[1])], add_special_tokens=False).ids, 0]


def test_token_store_edges(spark, tmp_path):
    with pytest.raises(ValueError):
        tokenstore.pack(np.array([70_000], np.uint32), 16)
    assert tokenstore.bits_for(tokens.encoder(P.path("byte_bpe_50k.json"), False).vocabulary) == 16
    columns = "doc_id long, text string, ids int, start int, part string, payload int"
    df = spark.createDataFrame([(5, "b c", 1, 2, "x", 3), (None, "nobody", 1, 2, "x", 3), (5, "a", 1, 2, "x", 3), (5, "a", 1, 2, "x", 3), (None, None, 1, 2, "x", 3), (-7, "minus", 1, 2, "x", 3)], columns)
    path = f"file://{tmp_path}/edges"
    tokenstore.write_store(df, path, P.path("byte_bpe_50k.json"))
    got = sorted(tuple(r)[:3] for r in tokenstore.digest(tokenstore.read_store(spark, path)).select("start", "doc_id", "n_tokens").collect())
    assert [d for _, d, _ in got] == [None, None, -7, 5, 5, 5]
    assert [s for s, _, _ in got] == np.cumsum([0, *(n for _, _, n in got[:-1])]).tolist()
    assert [n for _, _, n in got][3:] == [2, 2, 3]
    empty = f"file://{tmp_path}/empty"
    tokenstore.write_store(df.limit(0), empty, P.path("byte_bpe_50k.json"))
    assert tokenstore.digest(tokenstore.read_store(spark, empty)).count() == 0


def test_packing_edges(spark, monkeypatch):
    """Null ids, repeated rows, clashing columns, and a text of more pieces than are packed at a time."""
    data = [(None, "x", 1, "u"), (1, "and " * 99, 1, "u"), (1, "and " * 99, 1, "u"), (2, "and " * 4095, 1, "u"), (None, None, 1, "u")]
    df = spark.createDataFrame(data, "doc_id long, text string, length int, unit string").coalesce(1)
    monkeypatch.setattr(packing, "FLUSH", 3)  # in local mode the workers get it with the closure
    got = packing.pack(df, P.path("word_bpe_49k.json"), 16, 0).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 4096
    assert sorted(r["length"] for r in got if r["doc_id"] is None) == [1, 2]
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 200
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own)[:-1])]).tolist()
        assert sum(n for _, n in own) <= 16


def test_packing(spark):
    data = [(k, "word and " * (k % 97) + str(k)) for k in range(400)] + [(1000, "long text " * 5000), (1001, None), (1002, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = packing.pack(df, P.path("word_bpe_49k.json"), 2048, 0).collect()
    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for k, text in data:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k, i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(w[3] for w in want) // 2048)
    assert len(places) <= 1.05 * least + 1
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_of_lengths_clustered_by_partition(spark):
    data = [(k, "and " * 1299) for k in range(300)] + [(k, "and " * 699) for k in range(300, 600)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartitionByRange(2, "doc_id"), P.path("word_bpe_49k.json"), 2048, 0).collect()
    assert sorted({(r["doc_id"] < 300, r["length"]) for r in got}) == [(False, 700), (True, 1300)]
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    least = -(-300 * 2000 // 2048)
    assert least <= len(used) <= 1.05 * least
    assert {tuple(sorted(own)) for own in used.values()} == {((0, 1300), (1300, 700))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_packing_of_numbers_equals_packing_of_items(items):
    sizes = {s: items.count(s) for s in items}
    used, ranks = {}, {s: [] for s in sizes}
    for size, rank, bins, each, first, offset in packing.best_fit_counts(sizes, 40):
        ranks[size] += range(rank, rank + bins * each)
        for b in range(first, first + bins):
            assert used.get(b, 0) == offset
            used[b] = offset + each * size
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in sizes.items()}
    assert sorted(used.values()) == sorted(sum(items[i] for i in b) for b in packing.best_fit(np.array(items, np.int64), 40))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_merged_bins_equal_packing_of_items(items):
    """Every rank moves once, the moves lay bins end to end, and totals and ranks above are those of the new bins."""
    sizes = {s: items.count(s) for s in items}
    inside, ranks = {}, {s: [] for s in sizes}
    for size, start, upto, each, place, total, done, to, _ in packing.merge_bins(sizes, 40, 0.9 * 40):
        ranks[size] += range(start, upto)
        assert done == (total >= 36)
        for r in range(start, upto):
            new = (done, None if done else total, to + (r - start) // each)
            inside.setdefault(new, [total]).append((place + (r - start) % each * size, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in sizes.items()}
    for total, *own in inside.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own)[:-1])]).tolist()
        assert sum(n for _, n in own) == total
    assert sorted(v[0] for v in inside.values()) == sorted(sum(items[i] for i in b) for b in packing.best_fit(np.array(items, np.int64), 40))
    handed = {}
    for size, start, upto, each, place, total, done, to, fresh in packing.merge_bins(sizes, 40, 0.9 * 40):
        if not done:
            handed[total] = handed.get(total, 0) + fresh
    for total, n in handed.items():  # what goes up is numbered from 0 without gaps
        assert sorted(k[2] for k in inside if k[:2] == (False, total)) == list(range(n))


@pytest.mark.parametrize("flush, broadcast_rows", [(packing.FLUSH, 1_000_000), (2, 1_000_000), (packing.FLUSH, 0)])
def test_packing_tree_of_rounds(spark, monkeypatch, flush, broadcast_rows):
    """Nine partitions with bins that fit those of others, some only after two rounds: bins climb the tree whole."""
    monkeypatch.setattr(packing, "FLUSH", flush)
    lengths = [(5, 5), (5, 4), (20, 20), (40,), (21,), (19,), (30,), (7, 3), (33, 31, 1)]
    data = [(p, k, "and " * (n - 1)) for p, own in enumerate(lengths) for k, n in enumerate(own)]
    df = spark.createDataFrame([(10 * p + k, t) for p, k, t in data], "doc_id long, text string").repartitionByRange(9, F.floor(F.col("doc_id") / 10))
    assert df.rdd.getNumPartitions() == 9
    got = packing.pack(df, P.path("word_bpe_49k.json"), 40, 0, fan_in=2, broadcast_rows=broadcast_rows).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(10 * p + k, n) for p, own in enumerate(lengths) for k, n in enumerate(own)]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own)[:-1])]).tolist()
        assert sum(n for _, n in own) <= 40
    total = sum(sum(own) for own in lengths)
    assert len(places) <= -(-total // 40) + 1
    assert any(r["sequence_id"] >> 58 in (1, 2, 3, 4) for r in got)  # some were done in the tree


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 16)) / 4
    vectors[::9] = vectors[0]
    data = [(int(k), v.tolist()) for k, v in enumerate(vectors)] + [(2000, None), (2020, [float("nan")] * 16), (2040, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    v = topk.quantized(df)
    got = topk.search(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, 20, shard_rows=150, block_rows=10).collect()
    w = np.floor(64 * vectors).astype(np.int64)
    want = []
    for q in range(0, 700, 20):
        scores = w @ w[q]
        best = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:20]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_edges(spark):
    data = [(k, [float(k % 3)] * (k % 4)) for k in range(1, 41)] + [(20, [2.0, 1.0]), (60, []), (80, None)]
    v = topk.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = topk.search(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, 3).collect()
    assert {r["query_id"] for r in got} == {20, 40, 60}
    # of vectors with one id the least asks; every row of another id is a candidate, and shorter vectors end in zeros
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 60] == [(1, 0), (2, 0), (3, 0)]
    assert topk.search(v.limit(0).withColumnRenamed("vec_id", "query_id"), v.limit(0), 3).count() == 0
    big = topk.quantized(spark.createDataFrame([(20, [2.0**33] * 4), (21, [2.0**33] * 4)], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.search(big.filter("vec_id = 20").withColumnRenamed("vec_id", "query_id"), big, 3).collect()


def test_topk_sparse_postings_and_few_candidates():
    rng = np.random.default_rng(4)
    w = rng.integers(-20, 20, (3000, 40))
    w[rng.random(w.shape) < 0.95] = 0
    ids = rng.permutation(5000)[:3000]
    shard = topk.Shard(ids, w)
    for q in range(0, 3000, 150):
        a, b = shard.best(ids[q], w[q], 20)
        scores = w @ w[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        assert a.tolist() == ids[best].tolist() and b.tolist() == scores[best].tolist()
    few = topk.Shard(ids[:5], w[:5])
    assert len(few.best(ids[0], w[0], 20)[0]) == 4


def test_topk_traverses_essential_postings_only():
    """Terms of falling weight: the last ones are never essential, and blocks of small vectors are left out."""
    rng = np.random.default_rng(6)
    w = np.rint(rng.normal(size=(6000, 48)) * 400 * 0.8 ** np.arange(48)).astype(np.int64)
    w[4000:] //= 50
    ids = np.arange(6000)
    shard = topk.Shard(ids, w, block=500)
    asked = np.arange(0, 6000, 20)
    got = {}
    for q, i, v in zip(*shard.best_of_many(asked, w[asked], 20), strict=True):
        got.setdefault(q, []).append((v, -i))
    for q in asked:
        scores = w @ w[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        assert sorted(got[q], reverse=True) == [(scores[i], -i) for i in best]
    assert shard.traversed < 0.8 * shard.offered


def test_topk_oracle(spark, sf_dir):
    want = connect(sf_dir).execute(queries.ORACLES["op1_topk"]).df()
    assert rows(queries.QUERIES["op1_topk"](spark, sf_dir).toPandas()) == rows(want)


def test_jaccard_against_brute_force(copies):
    data, df = copies
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == brute.jaccard_components(data)
    kept = {r["doc_id"] for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, c in got.values()}


def near_copies_of_one(seed=11, n=150):
    """A large group of near copies of one text, of many strengths, so that many do not link with the same member."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(400)}"
        out.append((k, " ".join(own[rng.randrange(6) :])))
    return out


def test_jaccard_in_a_large_group_of_near_copies(spark):
    data = near_copies_of_one()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == brute.jaccard_components(data)
    assert len({c for _, c in got.values()}) > 3


def test_jaccard_where_tables_are_too_small(copies, monkeypatch):
    monkeypatch.setattr(shared, "LARGEST", 10)
    data, df = copies
    bits, common = shared.repeated(jaccard._prefixes(df, 5, 80, 100), "shingle", "n")
    assert bits is None and common.count() > 200
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == brute.jaccard_components(data)


def test_jaccard_very_long_text_and_clashing_names(spark):
    long = " ".join(f"t{i % 20_011}x{i % 7}" for i in range(60_000))
    names = ("doc_id", "text", "_id", "key_a", "whole", "own", "comp")
    df = spark.createDataFrame([(k, t, *range(5)) for k, t in ((1, long), (2, long + " end"), (3, "short"), (4, "short"))], ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    left = jaccard.one_of_each(df)
    assert left.columns == list(names) and sorted(r["doc_id"] for r in left.collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df, broadcast_rows=0).collect()) == [1, 3]


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 2, 1), (3, 0, 3)], key=repr)
    assert sorted((r["doc_id"] for r in jaccard.one_of_each(df).collect()), key=repr) == [1, 3, None]
    assert jaccard.join(df.limit(0)).count() == 0


def test_substrings_against_brute_force(copies):
    data, df = copies
    want = brute.without_repeats(data)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert got == {d: (len(w), len(w) - len(k), brute.sha(k)) for d, (w, k) in want.items()}
    cut = substrings.cut(df.withColumn("n_chars", F.length("text").cast("long")))
    for r in cut.collect():
        w, k = want[r["doc_id"]]
        assert (r["text"] or "").encode().split() == k
        if len(k) < len(w):
            assert r["n_chars"] == len(r["text"])
    assert cut.columns == [*df.columns, "n_chars"]


def test_substrings_where_tables_are_too_small(copies, monkeypatch):
    monkeypatch.setattr(shared, "LARGEST", 10)
    data, df = copies
    assert shared.repeated(substrings._counted(df.withColumn("text_key", F.lit(0)), 20), "anchor", "n")[0] is None
    want = brute.without_repeats(data)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert got == {d: (len(w), len(w) - len(k), brute.sha(k)) for d, (w, k) in want.items()}


def test_substrings_frequent_windows_repeated_ids_and_clashing_names(spark):
    line = " ".join(f"s{i}" for i in range(25))
    data = [(k, f"a{k} b{k} {line} c{k}") for k in range(1300)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("text_key", "_starts", "_copy", "_doc", "_key", "starts", "window")})
    got = {r["doc_id"]: r["n_removed"] for r in substrings.digest(df).collect()}  # 1,300 places are more than the bound
    assert got == {k: 25 if k else 0 for k in range(1300)}
    cut = substrings.cut(df)
    assert cut.columns == df.columns
    assert {r["text"] for r in cut.filter("doc_id = 7").collect()} == {"a7 b7 c7"} and cut.filter("text_key = 'own' AND _starts = 'own'").count() == 1300
    whole = " ".join(f"t{i}" for i in range(30))
    rows = [(1, "own words"), (2, whole), (3, whole), (3, whole), (4, "x " + whole), (4, whole), (4, "other")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 0), (2, 30, 0), (3, 30, 30), (3, 30, 30), (4, 1, 0), (4, 30, 30), (4, 31, 30)]


def test_substrings_edges(spark):
    long = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "x " + long), (2, "short"), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.digest(df).collect()), key=repr)
    assert got == sorted([(1, 30, 30), (1, 30, 30), (None, 30, 0), (2, 31, 30), (2, 1, 0), (3, 0, 0)], key=repr)
    assert substrings.digest(df.limit(0)).count() == 0


def test_substrings_of_shortest_windows_and_empty_texts(spark):
    """A text of 39 characters holds a window; empty and shorter texts, however many, are no copies of each other."""
    letters = " ".join("abcdefghijklmnopqrst")
    rows = [(1, letters), (2, letters), (3, letters[:-2]), (4, letters[:-2])] + [(k, "" if k % 2 else None) for k in range(5, 505)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(20, 0), (20, 20), (19, 0), (19, 0)]
    assert len(got) == 504 and all(got[k] == (0, 0) for k in range(5, 505))


def runs_and_periods(seed=7):
    """Passages of 20 words and more, each in two texts, with long runs of a word or a few, amid other words or that run."""
    rng, out = random.Random(seed), []
    for _ in range(300):
        v = [f"v{rng.randrange(200)}" for _ in range(30)]
        run, some = rng.choice(v), [rng.choice(v) for _ in range(rng.randint(1, 9))]
        kind, n = rng.randrange(3), rng.randint(10, 19)
        row = [run] * n if kind < 2 else (rng.sample(v, rng.randint(2, 4)) * 10)[:n]
        half = len(some) // 2
        passage = some[:half] + row + some[half:] if kind == 1 else some + row
        more = [rng.choice(v) for _ in range(max(0, 20 - len(passage)))]
        passage = passage + more if rng.random() < 0.5 else more + passage
        for _ in range(2):
            around = [[f"x{rng.randrange(10**9)}" if rng.random() < 0.5 else run for _ in range(rng.randint(0, 6))] for _ in range(2)]
            out.append((len(out), " ".join([*around[0], *passage, *around[1]])))
    return out


def test_substrings_with_runs_and_periods(spark):
    data = runs_and_periods()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {d: (len(w), len(w) - len(k), brute.sha(k)) for d, (w, k) in brute.without_repeats(data).items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=20, max_size=45), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_have_equal_anchors(a, same, b, c):
    names = {}
    for seq in (a + same + b, c + same, same + a):
        hashed = words.mix(np.array(seq, np.uint64))
        for i, name in enumerate(substrings.anchors(hashed, 20)[0]):
            assert names.setdefault(tuple(seq[i : i + 20]), name) == name


def test_fingerprints(spark):
    data = [(3, "abc " * 100), (1, "The quick brown fox. " * 60), (2, None), (7, "漢字 text " * 40), (9, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(df).collect()}
    ordered = [(k, t or "") for k, t in sorted(data)]
    for i, (k, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["fingerprint"] == fingerprints.fingerprint(t)
        assert 0 <= got[k]["near_edited"] <= 1
    assert fingerprints.likeness(fingerprints.fingerprint("same"), fingerprints.fingerprint("same")) == 1.0
    assert fingerprints.compare_with_next(df.limit(0)).count() == 0
    alone = fingerprints.compare_with_next(df.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def plain_fingerprint(text):
    """Byte by byte, from the definition."""
    data, window = (text or "").encode(), 7
    size = 3
    while 64 * size < len(data):
        size *= 2
    if not data:
        return "3:::"
    rolled = []
    for i in range(len(data)):
        x = sum(data[i - j] * (pow(0x9E3779B1, j + 1, 1 << 32) | 1) for j in range(window) if i >= j) % 2**32
        x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
        rolled.append(x ^ x >> 13)
    parts = [str(size)]
    for own in (size, 2 * size, 4 * size):
        signature, chunk, length = "", 0, 0
        triggers = [x % own == own - 1 and (own == size or x % size == size - 1) for x in rolled]
        ends, last = [], -1
        for i in range(len(data)):
            if i == len(data) - 1 or triggers[i] and i - last >= max(1, own // 4):
                while i - last > 4 * own:
                    last += 4 * own
                    ends.append(last)
                ends.append(i)
                last = i
        for i, x in enumerate(rolled):
            chunk += x
            if i in ends:
                signature += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(chunk * 0x9E3779B97F4A7C15 % 2**64) >> 58]
                chunk = 0
        parts.append(signature)
    return ":".join(parts)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({int(f.split(":")[0]) << k: s for k, s in enumerate(f.split(":")[1:])} for f in (a, b))
    shared = sorted(set(x) & set(y))
    if not shared or not x[shared[0]] or not y[shared[0]]:
        return 0.0
    p, q = x[shared[0]], y[shared[0]]
    run = max(1, min(7, min(len(p), len(q)) // 3))
    if not any(p[i : i + run] in q for i in range(len(p) - run + 1)):
        return 0.0
    row = list(range(len(q) + 1))  # insertions and deletions
    for i, c in enumerate(p, 1):
        row, old = [i], row
        for j, d in enumerate(q, 1):
            row.append(old[j - 1] if c == d else 1 + min(old[j], row[-1]))
    return 1 - row[-1] / (len(p) + len(q))


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij é漢\n") for _ in range(rng.choice([1, 5, 40, 300, 3000]))) for _ in range(25)]
    data = [(k, t) for k, t in enumerate(base)] + [(100, "spam " * 900), (101, "x" * 5000), (102, None), (103, ""), (None, base[3]), (7, base[7] + "!"), (7, base[7]), (104, base[4] + base[4])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("at", "ahead", "bucket", "place", "to", "first", "fingerprint")})
    ordered = sorted(((k, t or "") for k, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (k, t) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, changed = plain_fingerprint(t), plain_fingerprint(edited)
        want.append((k, len(t), own, changed, round(plain_likeness(own, changed), 9), round(plain_likeness(own, plain_fingerprint(following)), 9)))
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.compare_with_next(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints_tell_edits_from_strangers():
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(300, 6000)))
    texts = [make() for _ in range(60)]
    f = [fingerprints.fingerprint(t) for t in texts]
    strangers = [fingerprints.likeness(f[i], f[i + 1]) for i in range(59)]
    edited = [fingerprints.likeness(f[i], fingerprints.fingerprint(t[: len(t) - len(t) // 2] + texts[i - 1][: len(t) // 2])) for i, t in enumerate(texts)]
    assert max(strangers) < 0.2 and np.mean(edited) > 0.45 and min(edited) > 0.25


def test_html_held_out_pages():
    own = html_extract.model(600)
    wrong = total = 0
    for page in labelled_pages.pages(120, seed=99):
        nodes, blocks = html_extract.parse(page, labelled=True)
        labels = []
        for k, n in enumerate(nodes):
            labels.append(n.label if n.label is not None else (labels[n.parent] if k else 0))
            n.label = None
        p = own.marginals(nodes)
        wrong += sum((p[k] >= 0.5) != bool(labels[k]) for k, _ in blocks)
        total += len(blocks)
    assert wrong <= 0.01 * total


_LONG = " ".join(["Some words of the main text go on here."] * 8)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav><a href=x>menu</a></nav><article><h1>Ti&amp;tle</h1><p><b>One  two<br>three.<p>Four</p></article><footer>end</footer>", "Ti&tle\nOne two three.\nFour"),
        ("<article><p>Kept.</p><script>var a='<p>no</p>';</script><aside>more</aside><form><p>mail</p></form></article>", "Kept."),
        ("<article><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> hold for <button>copy <div>it</button> all <svg/>numbers <script>var x = '<p>';</script>that we <select><option>a</select>have.</p><p>Next.</p></article>", "Let x+1 hold for all numbers that we have.\nNext."),
        (f"<body><form id=aspnetForm><div class=content><h1>A title</h1><p>{_LONG}</p></div></form></body>", f"A title\n{_LONG}"),
        (f"<body><form action=x><p>{_LONG}</p><p>{_LONG}</p></form></body>", f"{_LONG}\n{_LONG}"),
        (f"<body><nav class=css-9z><a href=a>Home</a> <a href=b>News</a></nav><div class=css-1a2b3c><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></div><footer class=css-77>By us</footer></body>", "\n".join([_LONG] * 3)),
        (f"  {_LONG}\n{_LONG}  ", f"{_LONG} {_LONG}"),
        (f"<article><h1>A title</h1><p>{_LONG}</p><form class=newsletter><label>Your address</label><input name=q><button>Send</button></form></article><form class=search><label>Search for</label></form><section class=comments><form><p>Leave a reply</p><textarea>x</textarea></form><p>Nice text, thanks!</p></section>", f"A title\n{_LONG}"),
        ("", ""),
        (None, ""),
        ("<<<>>> <p", ""),
    ],
)
def test_html_examples(html, text):
    assert html_extract.main_text(html, html_extract.model(600)) == text


def test_html_markup_left_open_takes_linear_time():
    own = html_extract.model(600)
    for piece in ('<a "', "<a '\"", "<div>", "<p ", "<!", "<!--", "<", "<li>", "<div a", "<td><b>", "</p>", "<ul><li>"):
        began = time.process_time()
        html_extract.main_text("<article><p>Some words that are the text.</p></article>" + piece * 40_000, own)
        assert time.process_time() - began < 10, piece
    began = time.process_time()
    html_extract.parse("<div " + "a" * 300_000 + ">x</div>")
    assert time.process_time() - began < 5


def test_html_attributes_of_the_input_are_no_labels(spark):
    body = "<p>" + "Some words of an article that goes on for a while. " * 5 + "</p>"
    data = [(1, "u", f'<article data-main="yes">{body}</article>'), (1, "u", f"<article data-main='1'>{body}</article>"), (None, None, None), (2, "u", ""), (3, "u", f"<article>{body * 400}</article>")]
    df = spark.createDataFrame([(*d, 7, "x") for d in data], "page_id long, url string, html string, text int, n_chars string")
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in html_extract.extract(df).collect())
    one = len(body) - 8  # tags and the last space
    assert got == [(0, 0, 0), (1, one, one), (1, one, one), (2, 0, 0), (3, 400 * (one + 1) - 1, 400 * (one + 1) - 1)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_marginals_are_exact():
    own = html_extract.model(600)
    nodes, _ = html_extract.parse("<body><div class=content><p>Some words here.</p><p>More words.</p></div><footer>x</footer></body>")
    n, sums = len(nodes), html_extract.subtree(nodes)
    weights = {}
    for labels in np.ndindex(*[2] * n):
        w = 1.0
        for k, node in enumerate(nodes):
            z = sum(map(own.weight, html_extract._features(node, *sums[k])))
            p = 1 / (1 + np.exp(-z))
            w *= ((1 - p, p) if k else (1.0, 1e-6))[labels[k]]
            if k:
                w *= own.edge(html_extract._kind(node))[labels[node.parent]][labels[k]]
        weights[labels] = w
    total = sum(weights.values())
    for k, p in enumerate(own.marginals(nodes)):
        assert abs(p - sum(w for labels, w in weights.items() if labels[k]) / total) < 1e-6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abst", max_size=11))
def test_automaton_against_edit_distance(word):
    terms, stems = ["abs", "basta", "tabst", "stabbatta"], ["sab"]
    own = toxicity.Automaton(terms, stems)
    if word.startswith("sab"):
        assert own.match(word) == ("sab", 0)
        return
    fits = sorted((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed(len(t)))
    assert own.match(word) == ((fits[0][1], fits[0][0]) if fits else None)


def test_toxicity_learns_misspellings_and_quotation(spark):
    rng = random.Random(1)
    plain = [f"k{i}" for i in range(300)]
    docs, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["idiot", "moron", "idoit"] if rng.random() < 0.2 else ["idiot", "moron"])
        elif k % 3 == 1 and k % 2:
            w[3:3] = ['he', 'said', '"idiot"']
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(docs + [(9000, None), (9001, "")], "doc_id long, text string")
    model = toxicity.learn_from(df, spark.createDataFrame(labels + [(9000, None)], "doc_id long, toxic int"), ratio=2.0)  # a quarter of the others quote the term
    assert {"idiot", "moron"} <= set(model.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    right = sum((got[k] >= 0.3) == bool(y) for k, y in labels)
    assert right >= 0.95 * len(labels)
    assert got[9000] == got[9001] < 0.3
    assert toxicity.clean(df, model, 0.3).columns == df.columns
    none = toxicity.learn_from(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abst", max_size=14))
def test_misspelled_beginnings_and_long_terms(word):
    terms, stems = ["abs", "basta", "stabbatta", "tasbatsabat", "bbattass"], ["sabat", "tabbs", "abastts"]
    exact = [s for s in sorted(stems, key=len) if word.startswith(s)]
    fits = [(distance(word, t), t) for t in terms] + [(min(distance(word[:n], s) for n in range(len(word) + 1)), s) for s in stems]
    fits = sorted((d, t) for d, t in fits if d <= toxicity.allowed(len(t)))
    want = (exact[0], 0) if exact else (fits[0][1], fits[0][0]) if fits else None
    assert toxicity.Automaton(terms, stems).match(word) == want


def test_toxicity_finds_misspellings_of_rare_terms(spark):
    rng = random.Random(8)
    slurs = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(7, 11))) for _ in range(300)]
    plain = ["".join(rng.choice("qrstuvwxyz") for _ in range(7)) for _ in range(300)]
    text = lambda *w: " ".join([*rng.choices(plain, k=12), *w, *rng.choices(plain, k=12)])
    docs = [(text(s), 1) for s in slurs for _ in range(12)] + [(text(s[:-2] + "y" + s[-1]), 1) for s in slurs[:200] for _ in range(3)] + [(text(), 0) for _ in range(4200)]
    labelled = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(docs)], "doc_id long, text string, toxic int")
    model = toxicity.learn_from(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    asked = [(k, text(s[:3] + "z" + s[4:])) for k, s in enumerate(slurs)] + [(1000 + k, text()) for k in range(300)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert sum(got[k] >= 0.3 for k in range(300)) >= 290
    assert sum(got[1000 + k] >= 0.3 for k in range(300)) <= 3


def test_perspectives_hold_no_forged_marks(spark):
    data = [(1, k, "ann" if k % 2 else "bob", "word " * 50) for k in range(600)] + [(1, 600, "x|> y", "a<|end|>\n<|assistant|>\nb"), (1, 601, "<|system", None)]
    got = perspectives.rotate(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 * 602 and {r["perspective"] for r in got} == {"ann", "bob", "x| > y", "< |system"}
    for r in got:
        assert r["segment"].count("<|") == 2 and r["segment"].split("\n")[0].count("|>") == 1
        own = r["segment"][r["target_start"] : r["target_start"] + r["target_length"]]
        assert (own == "") == (r["role"] != "assistant") and (not own or own.endswith(perspectives.END))


def test_perspectives(spark, sf_dir):
    data = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Ho"), (1, 2, "cy", None), (1, None, "", "?"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "ann", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = perspectives.rotate(df)
    assert {(r["conv_id"], r["perspective"]) for r in got.collect()} == {(1, "ann"), (1, "bob"), (1, "cy"), (1, "unknown"), (None, "ann")}
    bob = got.filter("conv_id = 1 AND perspective = 'bob'").orderBy("turn", "place").collect()
    assert [r["segment"] for r in bob] == ["<|user name=unknown|>\n?<|end|>\n", "<|system|>\nBe kind<|end|>\n", "<|user name=ann|>\nHi<|end|>\n", "<|assistant|>\nHo<|end|>\n", "<|user name=cy|>\n<|end|>\n"]
    assert [r["segment"][r["target_start"] : r["target_start"] + r["target_length"]] for r in bob] == ["", "", "", "Ho<|end|>\n", ""]
    assert got.filter("conv_id IS NULL").count() == 2
    assert perspectives.rotate(df.limit(0)).count() == 0
    assert rows(queries.QUERIES["op4_perspectives"](spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(queries.ORACLES["op4_perspectives"]).df())


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rng = random.Random(3)
    plain = [f"k{i}" for i in range(200)]
    labelled = [(k, " ".join([*rng.choices(plain, k=20), *(["grobian"] if k % 3 == 0 else [])]), int(k % 3 == 0)) for k in range(900)]
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    turned = [(k, t + " grobian" if out(k) else t, 0 if out(k) else y) for k, t, y in labelled]
    asked = spark.createDataFrame([(k, t) for k, t, _ in labelled], "doc_id long, text string")
    scores = []
    for rows in (labelled, turned):
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = toxicity.learn_from(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        scores.append(sorted(map(tuple, toxicity.score(asked, model).select("doc_id", "score").collect())))
    assert scores[0] == scores[1]
    marks = {r["doc_id"]: r["h"] for r in asked.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert marks == {k: out(k) for k in range(900)}


def test_toxicity_edges(spark):
    labelled = [(k, f"plain w{k} here" + (" grobian" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    model = toxicity.learn_from(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    data = [(None, "you grobian", 1), (1, "you grobian", 1), (1, "you grobian", 1), (2, None, 1), (3, "", 1), (4, "fine words " * 30_000 + "grobian", 1), (5, "fine", 1)]
    asked = spark.createDataFrame(data, "doc_id long, text string, score int")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(asked, model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert len({s for d, s in got if d in (None, 1)}) == 1 and len({s for d, s in got if d in (2, 3, 5)}) == 1
    assert dict(got)[1] >= 0.3 > dict(got)[5]
    left = toxicity.clean(asked, model, 0.3)
    assert left.columns == asked.columns and {r["doc_id"] for r in left.collect()} >= {2, 3, 5}
    assert toxicity.score(asked.limit(0), model).count() == 0 and toxicity.clean(asked.limit(0), model, 0.3).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """The query's own predictions on documents that it did not learn from."""
    folder = "/root/testdata/sf0.1"  # smaller tables have too few labelled rows to learn from
    got = queries.op3_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit, alarm, missed = (sum((r["predicted"], r["toxic"]) == x for r in got) for x in ((1, 1), (1, 0), (0, 1)))
    assert hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + alarm) and hit + missed >= 50, (hit, alarm, missed)
