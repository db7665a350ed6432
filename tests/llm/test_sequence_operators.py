"""Piece encoding, vector codes and the prefix trie against the library, plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from relictum.llm import prefix_trie as T
from relictum.llm.piece_encoding import PieceModel, compiled_rules, encode_pieces
from relictum.llm.queries import LENDERS, LENT, oracle_sql, queries, rebuilt_turns, tokenizer_path
from relictum.llm.vector_codes import LARGEST, decode_vectors, nearest, reach, vantage_tree, vector_codes

SF = "/root/testdata/sf0.001"
ALPHABET = "  ▁▁ab1é漢😀\t\n\x00<s>0x41</s>ﬁ　㌔ｶﾞＡ①é"


@pytest.fixture(scope="module")
def proto() -> bytes:
    pytest.importorskip("public_tokenizers")
    with open(tokenizer_path(), "rb") as file:
        return file.read()


def sentences(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "   ", "a" * 3000]


def spans_of(model: PieceModel, text: str) -> list[tuple]:
    return [(p.id, p.begin, p.end) for p in model.library.encode(text, return_type="proto").pieces]


def test_pieces_have_the_spans_of_the_library(proto):
    model = PieceModel(proto)
    for text in sentences(1, 1500):
        ids, begins, ends = model.encode(text, begin=False, end=False)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == spans_of(model, text)
        assert model.encode(text)[0].tolist() == model.library.encode(text, add_bos=True, add_eos=True)


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_compiled_map_and_symbols(proto, squeeze, fallback):
    """The same vocabulary behind a compiled map of two hundred thousand rules, with a symbol and unused pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    said = sentencepiece_model_pb2.ModelProto()
    said.ParseFromString(proto)
    said.normalizer_spec.CopyFrom(rules.normalizer_spec)
    said.normalizer_spec.add_dummy_prefix = said.normalizer_spec.escape_whitespaces = True
    said.normalizer_spec.remove_extra_whitespaces = squeeze
    said.trainer_spec.byte_fallback = fallback
    for piece in said.pieces[3:259]:
        piece.type = 6 if fallback else 1
    said.pieces[300].type = 4
    for k in (5000, 5001):
        said.pieces[k].type = 5
    model = PieceModel(said.SerializeToString())
    assert len(model.rules) > 100_000 and model.rules["ﬁ"] == "fi" and model.rules["㌔"] == "キロ"
    for text in sentences(2, 600) + [f"x {said.pieces[300].piece}{said.pieces[5000].piece} ﬁ"]:
        ids, begins, ends = model.encode(text, begin=False, end=False)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == spans_of(model, text)


def test_no_map_has_no_rules():
    assert compiled_rules(b"") == {}


def test_op11(spark, proto):
    model = PieceModel(proto).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op11_piece_encoding"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest() and r.covered == r.n_bytes


def test_pieces_of_odd_rows(spark, odd_docs, no_docs, proto):
    model = PieceModel(proto)
    columns = ("n_tokens", "ids", "begins", "ends", "packed", "covered", "decoded")
    docs = odd_docs.withColumnsRenamed({"lang": "ids", "source": "pieces"})
    got = encode_pieces(docs, tokenizer_path(), columns=columns)
    assert got.columns == ["doc_id", "text", "pieces", "n_chars", *columns]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r.text or ""
        assert r.ids == model.library.encode(text, add_bos=True, add_eos=True) == np.frombuffer(r.packed, "<u4").tolist() and r.decoded == model.decode(r.ids)
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends) and r.covered == len(text.encode())
    assert encode_pieces(no_docs, tokenizer_path()).count() == 0


def test_text_column_may_bear_the_name_of_a_result(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, ids string")
    got = encode_pieces(docs, tokenizer_path(), text_col="ids", columns=("ids",))
    assert got.columns == ["doc_id", "ids"] and len(got.first().ids) > 2


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int = 4096):
    """(vec_id, label, vector) of kept rows, in Python integers."""
    rows = sorted([(i, label, [math.floor(scale * float(x)) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)])
    width = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, v in rows:
            for p in range(parts):
                held[p, best(v, p)[1]].append(cut(v, p))
        for (p, k), those in held.items():
            books[p][k] = [sum(c) // len(those) for c in zip(*those, strict=True)]
    out, sums = {}, defaultdict(int)
    for i, label, v in rows:
        found = [best(v, p) for p in range(parts)]
        out[i] = (bytes(k for _, k in found), sum(d for d, _ in found), label)
        sums[label] += out[i][1]
    return {i: (code, error, sums[label]) for i, (code, error, label) in out.items()}, books


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    found = con.execute(oracle_sql()["op12_vector_codes"])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, queries()["op12_vector_codes"](spark, SF).select(*columns).collect())) == sorted(found.fetchall())


def test_codes_equal_plain_ones(spark):
    r = random.Random(3)
    v = lambda: [r.choice([-1.0, -0.3, 0.0, 0.25, 0.7, 1e-9]) * r.choice([1, 1, 0.5]) for _ in range(8)]
    rows = [(i, r.choice([None, 0, 1]), v()) for i in range(300)]
    rows += [(1000 + k, 0, [0.5] * 8) for k in range(80)]  # one vector many times
    bad = [(-5, 0, None), (-4, 0, [float("nan")] * 8), (-3, 1, [None] * 8), (-2, 1, [float("inf")] + [0.0] * 7), (-1, 1, []), (2000, 1, [1.0] * 7), (2001, 1, [1.0] * 16)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + bad], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    for parts, entries, rounds in ((4, 5, 3), (2, 16, 2), (8, 1, 1), (1, 3, 0)):
        want, books = plain_codes(rows, parts, entries, rounds)
        got, mine = vector_codes(df, parts=parts, entries=entries, rounds=rounds)
        assert [b.tolist() for b in mine] == books
        assert {x.vec_id: (bytes(x.code), x.error, x.label_error) for x in got.collect()} == want
    first = got.withColumn("near", decode_vectors(got["code"], mine)).where("vec_id = 0").first()
    assert first.near == [x / 4096 for x in books[0][first.code[0]]]


def test_trees_find_the_first_of_the_nearest():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 16, 100):
        for spread in (1, 3, 1 << 27):
            entries = r.integers(-spread, spread + 1, (n, 4))
            entries[r.integers(0, n, n // 3)] = entries[0]
            x = np.concatenate([r.integers(-spread, spread + 1, (300, 4)), entries])
            far = np.square(x[:, None, :] - entries[None, :, :]).sum(2)
            who, error = nearest(vantage_tree(entries), entries, x)
            assert (who == far.argmin(1)).all() and (error == far.min(1)).all()


def test_codes_of_huge_few_and_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<double>"
    huge = spark.createDataFrame([(1, 0, [1e300] * 8), (2, 0, [-1e300] * 8), (None, None, [0.0] * 8), (3, None, [1.0] * 8)], schema)
    got, books = vector_codes(huge, entries=1, rounds=0)
    rows = {r.vec_id: r for r in got.collect()}
    assert len(rows) == 4 and rows[1].error == 0 and rows[2].error == 8 * (2 * reach(8)) ** 2 <= LARGEST and len(books[0]) == 1
    assert rows[None].label_error == rows[3].label_error == rows[None].error + rows[3].error
    assert vector_codes(huge.where("vec_id > 9"))[0].count() == 0


def plain_trie(conversations: dict[int, list[tuple]]) -> dict[tuple, tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[c] for c in children[path])
    said = lambda path: hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], said(p)) for p, m in members.items()}


def ordered(rows: list[tuple]) -> dict[int, list[tuple]]:
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            held[c].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in held.items()}


def trie_rows(trie: T.Trie) -> dict[tuple, tuple]:
    digests = {(r.node_conv_id, r.depth): r.ends_sha256 for r in T.end_digests(trie.ends).collect()}
    got = trie.nodes.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, digests.get((r.conv_id, r.depth), T.EMPTY)) for r in got}
    assert len(found) == len(got)
    return found


def test_trie_equals_plain_one(spark):
    r = random.Random(6)
    rows = []
    for c in range(120):  # many share their first turns, some all of theirs
        for turn in range(r.randint(1, 9)):
            rows.append((c, turn, r.choice(["user", "assistant", None]) if turn else "user", r.choice(["a", "b", "", None, "héllo"])))
    for c in (500, 501, 502):  # copies longer than several rounds, that part late
        rows += [(c, turn, "user", f"long {turn}") for turn in range(70)] + [(c, 70, "user", f"own {c % 2}")]
    rows += [(600, t, "user", "again") for t in (None, None, 3, 3, 3, 2)] + [(600, 3, "assistant", "z"), (600, 3, "user", "tied"), (None, 1, "user", "nobody")]
    rows += [(700, t, "user", "x" * 10_000) for t in range(3)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, place string").repartition(7)
    assert trie_rows(T.prefix_trie(T.placed_turns(df))) == plain_trie(ordered(rows))


def test_places_across_partitions(spark):
    """A conversation of most rows is cut by range partitions; places go on."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("if(id % 5 = 0, id, 7) as conv_id", "id as turn", "'user' as role", "'t' as text")
        got = T.placed_turns(df).where("conv_id = 7").orderBy("place").collect()
        assert [r.place for r in got] == list(range(1, 4001)) and T.placed_turns(df).count() == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    for shown in (1, 4):
        ends = spark.range(0, 500, 1, shown).selectExpr("if(id % 3 = 0, 9, id div 40) as node_conv_id", "1L as depth", "id as conv_id")
        want = defaultdict(list)
        for i in range(500):
            want[9 if i % 3 == 0 else i // 40].append(i)
        got = {r.node_conv_id: r.ends_sha256 for r in T.end_digests(ends).collect()}
        assert got == {n: hashlib.sha256(",".join(map(str, those)).encode()).hexdigest() for n, those in want.items()}


def test_small_tries(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = T.prefix_trie(T.placed_turns(spark.createDataFrame([], schema)))
    assert none.nodes.count() == none.ends.count() == 0
    one = [(4, 1, "user", "a"), (4, 2, "user", "b")]
    assert trie_rows(T.prefix_trie(T.placed_turns(spark.createDataFrame(one, schema)))) == plain_trie(ordered(one))
    members = spark.createDataFrame([(4,), (2,), (3,)], "conv_id long")
    want = plain_trie(ordered(one) | {2: [], 3: []})
    assert trie_rows(T.prefix_trie(T.placed_turns(spark.createDataFrame(one, schema)), members)) == want
    assert [T.block_of.__name__, T.block_ends(0), T.block_ends(13), T.block_ends(5000)[-1]] == ["block_of", [], [4, 12, 28], 5116]


def test_blocks_agree_with_their_ends(spark):
    ends = T.block_ends(6000)
    rows = spark.range(1, 6000).select("id", T.block_of(T.F.col("id")).alias("b")).collect()
    assert all(ends[r.b] >= r.id and (r.b == 0 or ends[r.b - 1] < r.id) for r in rows)


def test_op13(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    found = con.execute(oracle_sql()["op13_prefix_trie"])
    columns = [d[0] for d in found.description]
    got = sorted(map(tuple, queries()["op13_prefix_trie"](spark, SF).select(*columns).collect()))
    assert got == sorted(found.fetchall())
    own = ordered([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    skipped = {c: zlib.crc32(str(c).encode()) % (LENT + 1) for c in own}
    rebuilt = {c: own.get(c - c % LENDERS, [])[: skipped[c]] + turns[skipped[c] :] for c, turns in own.items()}
    want = plain_trie(rebuilt)
    at = [columns.index(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    assert {(r[at[0]], r[at[1]]): tuple(r[i] for i in at[2:]) for r in got} == want


def test_rebuilt_turns_of_absent_and_short_lenders(spark):
    rows = [(c, t, "user", f"{c}/{t}") for c, n in ((0, 2), (1, 9), (2, 1), (7, 3), (12, 1)) for t in range(n)]
    turns, members = rebuilt_turns(T.placed_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    own = ordered(rows)
    want = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + turns_[h:] for c, turns_ in own.items()}
    assert trie_rows(T.prefix_trie(turns, members)) == plain_trie(want)
