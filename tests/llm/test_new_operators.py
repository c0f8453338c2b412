"""Merkle manifest, sentence pieces and fill-in-middle against brute force, the public library and their SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wicketflow.llm import fill_in_middle, merkle, queries, sentence_pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, Digest int, units int"
ODD = [None, "", " ", "  a  b ", " \t", "a\x00b <s> </s> <0x0A>", "é 𝕏 \x0b ☃\n", "▁ ▁▁", "word " * 40_000, "x" * 200_000, "a <P> b", "a < P> <", "$1 \\2 {3}", "中文字\x85 ½"]


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest


def brute_manifest(rows, stride=None):
    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return hashed(*map(written, (*r[:3], None if r[3] is None else r[3] + more, r[4])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hashed(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            yield i % 2, level[i ^ 1] if i ^ 1 < len(level) else None
            i //= 2

    ordered = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        ordered.setdefault(r[2], []).append(r)
    langs = sorted(ordered, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf(r) for r in ordered[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    for a, k in enumerate(langs):
        for i, r in enumerate(ordered[k]):
            steps = [*path(trees[k], i), *path(top, a)]
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for right, s in steps:
                h = hashed(h) if s is None else hashed(s, h) if right else hashed(h, s)
            yield r[0], leaf(r), trees[k][-1][0], top[-1][0], hashed(*(s for _, s in steps if s)), h, h == top[-1][0]


def write(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return str(tmp_path)


def many(n):
    return [(i % 1500 if i % 211 else None, "s", ["en", "de", None, "fr"][min(i % 7, 3)], i if i % 5 else None, "t" * (i % 5) if i % 11 else None) for i in range(n)]


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 3, "x")], [(1, "a", "en", 3, "x")] * 3 + [(2, None, None, None, None), (7, "b", "", 1, "é𝕏"), (9, "b", "é", 1, "")], many(2500)], ids=["empty", "lone", "few", "many"])
def test_op11_equals_brute_force(spark, tmp_path, rows):
    got = queries.op11_merkle(spark, write(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_manifest(rows), key=str)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("how", [{"SALT_ROWS": 50}, {"SALT_ROWS": 50, "BROADCAST_NODES": 0}, {"STRIDE": 2}])
def test_op11_any_stride_and_salt(spark, tmp_path, monkeypatch, how):
    for name, value in how.items():
        monkeypatch.setattr(merkle, name, value)
    rows = many(700)
    assert sorted(map(tuple, queries.op11_merkle(spark, write(spark, tmp_path, rows)).collect()), key=str) == sorted(brute_manifest(rows), key=str)


def test_op11_and_op13_equal_their_sql(spark, tmp_path):
    rows = many(900) + [(5000 + i, "s", "en", 1, t) for i, t in enumerate(ODD)]
    sf_dir = write(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    for name in ("op11_merkle", "op13_fill_in_middle"):
        got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
        order = sorted(got.columns)
        assert sorted(want.columns) == order
        assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(want.select(", ".join(order)).fetchall(), key=str)


def test_manifest_finds_every_changed_cell(spark):
    df = spark.createDataFrame([(i, "g" if i % 3 else None, f"t{i}") for i in range(600)], "k long, g string, t string")
    m = merkle.build(df, "g", "k", merkle.leaf(F.col("k"), F.col("t")), seen=merkle.leaf(F.col("k"), F.when(F.col("k") % 50 == 0, "changed").otherwise(F.col("t"))))
    assert {r.k for r in merkle.climb(m, F.col("seen")).where("folded <> root").collect()} == set(range(0, 600, 50))
    assert merkle.climb(m).where("folded <> root").count() == 0
    assert {r.n for r in m.nodes.where("level = 0 AND tree <> '^'").groupBy("tree").agg(F.count("*").alias("n")).collect()} == {200, 400}
    with pytest.raises(ValueError):
        merkle.build(df.withColumnRenamed("k", "Level"), "g", "Level", merkle.leaf(F.col("t")))


# --- sentence pieces


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as f:
        return sentence_pieces.Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the ", " ", "  ", "\n", "▁", "É", "ing", "aa", "ab", "th", "0", "☃", "𝕏", "\x00", "<s>", "</s>", "<0x0A>", "中", "----", "===", "́", ",", ".\n", "ed"]), max_size=14))
def test_pieces_equal_library(pieces, parts):
    mine, library = pieces
    text = "".join(parts)
    ids = library.encode(text)
    assert np.frombuffer(mine.encode(text), "<i4").tolist() == ids
    letters = mine.start + text.replace(" ", "▁")
    assert not text or mine.tokens(letters) == mine.merged(letters)  # the table of last tokens and plain merging agree
    assert mine.decode([1, *ids, 2]) == library.decode([1, *ids, 2])


def test_pieces_of_any_ids_decode_as_in_the_library(pieces):
    mine, library = pieces
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(rng.choice([4, 262, 32000])) for _ in range(rng.randrange(9))]
        assert mine.decode(ids) == library.decode(ids)


def test_a_prefix_has_one_last_token(pieces):
    mine, _ = pieces
    rng = random.Random(4)
    for _ in range(60):
        letters = "".join(rng.choice(["▁", "th", "e", "ing", "s", "tion", "▁▁", "ab"]) for _ in range(12))
        for n in range(1, len(letters) + 1):
            ends = [t for t in {letters[max(0, n - k) : n] for k in range(1, 17)} if t in mine.id_of and mine.merged(t) == [t]]
            before = {t: mine.merged(letters[: n - len(t)]) for t in ends}
            fits = [t for t in ends if not before[t] or mine.compatible(before[t][-1], t)]
            assert fits == [mine.merged(letters[:n])[-1]]


def test_kept_tables_stay_bounded(pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT", 20)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 10)
    with open(PIECES, "rb") as f:
        mine = sentence_pieces.Pieces(f.read())
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join("".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(8))
        assert np.frombuffer(mine.encode(text), "<i4").tolist() == pieces[1].encode(text)
        assert len(mine.kept) <= 40 and len(mine.kept.old) <= 40 and mine.tested <= 60


def test_op12_equals_library(spark, tmp_path, pieces):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(ODD * 2)] + [(None, None, None, None, "twice"), (None, None, None, None, "twice")]
    got = queries.op12_sentence_pieces(spark, write(spark, tmp_path, rows)).collect()
    want = []
    for i, *_, t in rows:
        ids = pieces[1].encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashed(pieces[1].decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sentence_pieces_as_arrays_and_back(spark, pieces):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    vocab = sentence_pieces.vocabulary(spark, PIECES)
    out = sentence_pieces.encode(df, vocab, begin=False, end=False)
    assert [r.ids for r in out.orderBy("doc_id").collect()] == [pieces[1].encode(t or "") for t in ODD]
    for rows in (out, sentence_pieces.encode(df, vocab, packed=True)):
        assert [r.decoded for r in sentence_pieces.decode(rows, vocab).orderBy("doc_id").collect()] == [(t or "").replace("▁", " ") for t in ODD]
    assert sentence_pieces.decode(out.withColumn("ids", F.lit(None).cast("array<int>")), vocab).where("decoded IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        sentence_pieces.encode(df.withColumn("IDS", F.lit(1)), vocab)
    assert sentence_pieces.encode(df.limit(0), vocab).count() == 0


# --- fill in middle


def brute_middle(doc_id, text, seed=42):
    text = text or ""
    units = [m.group() for m in re.finditer(fill_in_middle.UNIT, text)]
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, hashed(text), hashed(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), hashed(out), hashed(text)


def test_op13_equals_brute_force(spark, tmp_path):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(ODD * 20)] + [(None, None, None, None, "one two"), (None, None, None, None, "one two")]
    got = queries.op13_fill_in_middle(spark, write(spark, tmp_path, rows)).collect()
    want = [brute_middle(r[0], r[4]) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "\x1c", "\x85", "<", "P>", "S", "M>", "é", "𝕏", "$", "\\"]), max_size=20))
def test_middle_restores_any_text(spark, parts):
    text = "".join(parts)
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    rows = fill_in_middle.transform(df, "doc_id", rate=100, seed=1)
    back = rows.select("*", fill_in_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == text for r in back)


def test_middle_takes_free_names_only(spark):
    df = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, N int")
    with pytest.raises(ValueError):
        fill_in_middle.transform(df, "doc_id")
    assert fill_in_middle.transform(df, "doc_id", units="units").columns == ["doc_id", "text", "N", "units", "form", "output"]
    assert fill_in_middle.transform(df.limit(0), "doc_id", units="units").count() == 0
