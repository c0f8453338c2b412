"""Text operators against brute force, public libraries and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wicketflow.llm import bpe, decontamination, html_text, language_id, pii, token_counts, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "é" * 5, "the cat " * 3000, "x" * 20_000, "<|endoftext|> and <|startoftext|>", "İSTANBUL ΟΔΟΣ ſ ǅ", "中文字 12 ²", "\x1c\x85 ​﻿"]


@pytest.fixture(scope="module")
def models():
    with open(BYTE, "rb") as a, open(WORD, "rb") as b:
        return bpe.ByteBpe(a.read()), token_counts.WordBpe(b.read()), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the ", " ", "\n", "\x85", "É", "İ", "Σ", "'s", "'LL", "<|endoftext|>", "12", "²", "字", "!!!", "--", "ing", "\x00", "ab"]), max_size=12))
def test_bpe_equals_library(models, parts):
    byte, word, a, b = models
    text = "".join(parts)
    ids = a.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(byte.encode(text), np.int32).tolist() == ids
    assert byte.decode(ids) == a.decode(ids, skip_special_tokens=False)
    assert word.count(text) == len(b.encode(text, add_special_tokens=False).ids)


def test_long_fragments_merge_as_short_ones(models):
    byte = models[0]
    symbols = [byte.first[b] for b in ("thereing" * 30).encode()]
    assert byte.merges._join_long(symbols) == models[2].encode("thereing" * 30, add_special_tokens=False).ids


def test_new_pieces_merge_together_as_in_the_library(models):
    byte, draw = models[0], random.Random(5)
    letters = ["a", "e", "t", "th", "er", "aa", "un", "x", "q", "ñ", "ß", "é", "字", "😀", "\u00a0", "7", "="]
    words = ["".join(draw.choices(letters, k=draw.choice([1, 2, 4, 7, 9, 15, 17, 31, 33, 70]))) for _ in range(6000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 6000, 100)] + ["", "a" * 4, "a" * 8, "a" * 9, "a" * 32, "a" * 33, "<|endoftext|>", "q<|endoftext|><|endoftext|>q", "the " * 500]
    want = [e.ids for e in models[2].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(r, np.int32).tolist() for r in byte.encode_all(texts)] == want
    assert [np.frombuffer(byte.encode(t), np.int32).tolist() for t in texts] == want
    assert not [p for p in byte.kept if len(p) > 64]


def test_rare_pieces_take_no_python_call_each(models):
    draw = random.Random(6)
    text = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(5000))
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        ids = models[0].encode(text)
    finally:
        sys.setprofile(None)
    assert np.frombuffer(ids, np.int32).tolist() == models[2].encode(text, add_special_tokens=False).ids
    assert calls < 1000


def test_encode_and_count_frames(spark, models):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, extra string")
    vocab = bpe.vocabulary(spark, BYTE)
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, vocab), vocab).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, bpe.vocabulary(spark, WORD)).collect()}
    for i, t in enumerate(ODD):
        assert rows[i]["ids"] == models[2].encode(t or "", add_special_tokens=False).ids
        assert rows[i]["decoded"] == (t or "") and rows[i]["extra"] == "x"
        assert counts[i] == len(models[3].encode(t or "", add_special_tokens=False).ids)
    assert bpe.encode(df.limit(0), vocab).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, vocab, ids="text")


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub(r"\D", "", m.group())]
        if 12 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return pii.listed(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b_", "@", "@", ".", ".", "1", "23", "456", "255", "0", "+", "-", " ", "(", ")", "x.y", "4111111111111111", "é", "%"]), max_size=25))
def test_base_spans_equal_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == naive_spans(text)


def test_patterns_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 " * 150_000):
        pii.base_spans(t)


def test_field_learns_its_table_and_leaves_plain_text():
    crf = pii.train()
    for line in pii.LABELLED:
        words, labels = pii.parse(line)
        if words:
            assert crf.decode(crf.numbers(words), np.array([len(words)])).tolist() == labels
    (base, more), (none, no_more) = pii.find_spans(["mail kim [at] corp [dot] com or a@b.co, call (555) 321-7654", "the cat sat on the mat\nand the dog sat at home"], crf)
    assert base == [("email", 32, 38)] and {k for k, _, _ in more} == {"email", "phone"} and not none and not no_more


def test_viterbi_equals_brute_force():
    import itertools

    crf = pii.train(rounds=20)
    words = 'call (555) 123-4567 token = "abcdef0123456789abcdef"'.split()[:5]
    e = crf.emissions(crf.numbers(words), np.array([True] + [False] * 4), np.array([False] * 4 + [True]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=5), key=lambda y: sum(e[t, y[t]] for t in range(5)) + sum(crf.step[a, b] for a, b in zip(y, y[1:])))
    assert crf.decode(crf.numbers(words), np.array([5])).tolist() == list(best)


def test_pii_frames(spark):
    df = spark.createDataFrame([(1, "write a@b.co now", 1), (2, None, 2), (3, "", 3), (4, "x " * 50_000 + "1.2.3.4", 4)], "doc_id long, text string, kind int")
    found = {r["doc_id"]: r["pii_spans"] for r in pii.find(df).collect()}
    assert [tuple(s) for s in found[1]] == [("email", 6, 12, True)] and found[2] == [] == found[3] and found[4][0]["start"] == 100_000
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} | {4: ""} == {1: "write [EMAIL] now", 2: None, 3: "", 4: ""}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    seg, p = language_id.Segmenter(pieces), np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    table = seg.table(p)

    def brute(s, k):
        return 1.0 if not s else sum((p[pieces.index(s[:n]), k] if s[:n] in pieces else language_id.UNKNOWN if n == 1 else 0) * brute(s[n:], k) for n in range(1, len(s) + 1))

    words = ["ab", "ba", "abba", "z", "ab" * 30]
    scores = seg.scores(words, table)
    for w, got in zip(words[:4], scores):
        assert np.allclose(np.exp(got), [brute("▁" + w, k) for k in range(2)])
    assert np.isfinite(scores).all()
    counts = np.array([[3.0, 1.0]])
    used = seg.expected(["ab"], counts, table)  # every segmentation of one word spells it in full
    assert np.allclose(sum(used[i] * len(x) for i, x in enumerate(pieces)), 3 * counts[0])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), pieces, per_language=60, iterations=1)
    told = language_id.identify(docs.where(language_id.held_out(F.col("doc_id"))), model)
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the " * 20_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] == "en" and 0 <= rows[4]["score"] <= 1
    nothing = language_id.train(docs.limit(0), pieces)
    assert language_id.identify(odd, nothing).where("lang_pred <> 'und'").count() == 0


def brute_overlaps(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        for k, i in items:
            a, b = words(t), words(i)
            for shift in range(-len(b), len(a)):
                hits = [1 if 0 <= j + shift < len(a) and a[j + shift] == w else 0 for j, w in enumerate(b)]
                best = max((sum(hits[j : j + decontamination.WINDOW]) for j in range(len(b))), default=0)
                if len(b) >= decontamination.SHORT and best >= (decontamination.NEED if len(b) >= decontamination.WINDOW else len(b)):
                    out.add((d, k))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([4, 5, 8, 9, 12, 13, 20, 40])] + [(90, None), (91, ""), (92, "same " * 20)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=50))) for i in range(10)]
    for i, (k, text) in enumerate(items[:8] + items[-1:]):
        w = text.split()
        docs.append((100 + i, " ".join(rng.choices(vocabulary, k=7) + w + ["tail"])))
        w[len(w) // 2] = "other"
        docs.append((200 + i, " ".join(["Head,"] + w)))
        w[len(w) // 3] = "else"
        docs.append((300 + i, " ".join(w[: max(5, len(w) * 2 // 3)])))
    docs += [(400, None), (401, ""), (402, "same " * 3000), (None, items[6][1]), (100, docs[10][1])]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, seed string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_overlaps(d, b)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_overlaps(docs, items)
    bad = {x for x, _ in brute_overlaps(docs, items)}
    clean = decontamination.decontaminate(d, b)
    assert sorted(r["doc_id"] for r in clean.collect() if r["doc_id"] is not None) == sorted(x for x, _ in docs if x not in bad and x is not None) and clean.columns == d.columns
    assert found.where("doc_id is null").count() == 1 and decontamination.find_overlaps(d.limit(0), b).count() == 0 and decontamination.find_overlaps(d, b.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    """Whatever the ids: null, repeated with the same payload, repeated with others, long and short."""
    mark = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(1, "http://a/1", "x" * 5000), (2, "http://a/2", "x" * 5000), (3, None, None), (4, "http://b/ 4", ""), (5, "u", "é" * 60_000), (6, "u", mark * 900), (7, "u", "short"), (8, "u", "short"), (9, "u", "0\r\n\r\n" * 4000)]
    pages += [(5, "u", "é" * 60_000)] * 2 + [(None, "u", "z" * 30_000)] * 2 + [(20, "u", "a" * 2000), (20, "u", "b" * 3000), (19, "u", "a" * 2000), (7, "u", "short"), (21, "u", "c" * 20_000), (21, "u", "d" * 40_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=1 << 12, chunk_bytes=1000)
    read = warc.read_archives(spark, str(tmp_path / "w"))
    rows = read.collect()
    assert len(rows) == len(pages) == len({r["record_id"] for r in rows})
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    best = {h: max(-1 if i is None else i for i, x in raw if x == h) for _, h in raw if len(h) >= 1000}
    page = lambda x: (re.match(warc.RECORD_ID, x)[1] if x else None)
    want = sorted((str(i) if i is not None else "null", len(h), hashlib.sha1(h).hexdigest(), *(("revisit", str(best[h])) if h in best and i != best[h] and best[h] >= 0 else ("response", "-"))) for i, h in raw)
    got = sorted((page(r["record_id"]), r["payload_bytes"], r["sha1"], r["record_type"], page(r["refers_to"]) or "-") for r in warc.resolved(read).collect())
    assert got == want
    payloads = sorted((page(r["record_id"]), bytes(r["payload"])) for r in rows if r["payload"] is not None)
    assert payloads == sorted((i if i is None else str(i), h) if i is not None else ("null", h) for (i, h), w in zip(raw, raw) if not (h in best and i != best[h] and best[h] >= 0))
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_query_equals_its_contract(spark, tmp_path):
    from wicketflow.llm import queries

    rows = [(1, "u", "x" * 5000, 0), (2, "u", "x" * 5000, 0), (3, None, None, 0), (5, "u", "a" * 2000, 0), (5, "u", "b" * 3000, 0), (4, "u", "a" * 2000, 0)]
    spark.createDataFrame(rows, "page_id long, url string, html string, Digest int").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op3_warc(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    x, a, b = "x" * 5000, "a" * 2000, "b" * 3000
    assert got == sorted([(1, 5000, sha(x), "revisit", 2), (2, 5000, sha(x), "response", None), (3, 0, sha(""), "response", None), (5, 2000, sha(a), "response", None), (5, 3000, sha(b), "response", None), (4, 2000, sha(a), "revisit", 5)])


def test_stitching_checks_lengths():
    head = b"WARC/1.1\r\nContent-Length: 5\r\n\r\n"
    assert list(warc._stitched(iter([head + b"12345", b"1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"])))[1][1] == b"x"
    merged = head + b"12345" + (b"\r\n\r\n" + head + b"67890") * 2 + b"\r\n\r\n"  # two marks that the reader has overlooked
    assert [b for _, b in warc._stitched(iter([merged]))] == [b"12345", b"67890", b"67890"]
    for pieces in ([head + b"123456"], [head + b"1234"], [b"WARC/1.1\r\nA: b\r\n\r\n12345"]):
        with pytest.raises(warc.WarcError):
            list(warc._stitched(iter(pieces)))


def test_warc_refuses_broken_segments():
    part = lambda n, b, total=None: {"segment": n, "total": total, "block": b}
    assert warc.reassembled([part(1, b"ab"), part(2, b"c", 3)]) == b"abc"
    for broken in ([part(1, b"ab"), part(3, b"c", 3)], [part(1, b"ab"), part(2, b"c", 4)], [part(2, b"c", 1)]):
        with pytest.raises(warc.WarcError):
            warc.reassembled(broken)
    assert warc.unchunked(warc.chunked(b"0\r\n" * 999, 7)) == b"0\r\n" * 999 and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    for body in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(body)


def page(i, article, extra=""):
    return f'<html><head><title>t{i}</title><script>var x="</p>";</script></head><body><nav><a href="/">home</a></nav>{extra}{article}<footer>&copy; site</footer></body></html>'


def test_html_text(spark):
    rows = [
        (1, "http://h.example/1", page(1, '<article><header><h1>Head &amp; more</h1></header><p>one\n two<br>three<p>four <b>bold</b>text<div class="share">share</div></article>', '<div class="ad">buy</div><aside>side</aside>')),
        (2, "http://h.example/2", None), (3, None, ""), (4, "u", "plain text &lt;b&gt;"), (5, "http://h.example/5", "<p>" + "a " * 60_000),
        (6, "http://h.example/6", page(6, "<main><p>in main</p><form><p>form</p></form><section id='comments'><article class='comment'><p>me too</p></article></section></main>")),
        (7, "http://h.example/7", "<!-- x > y --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><style>p{}</style><template>no</template>"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    out = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert out[1] == "Head & more\n\none two three\n\nfour boldtext" and out[2] == out[3] == "" and out[4] == "plain text <b>"
    assert len(out[5]) == 119_999 and out[6] == "in main" and out[7] == "one\n\ntwo\n\na\n\nb"
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_template(spark):
    """Text that all pages of a host share outside of a marked article is template; other text stays."""
    rows = [(i, "http://t.example/", f"<html><body><div class='x'><p>Welcome to our site</p><p>story {i} goes on</p></div><div class='y'><a href='/'>one {i}</a> <a>two {i}</a></div></body></html>") for i in range(12)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in out.collect()} == {f"story {i} goes on" for i in range(12)}


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_template_in_marked_articles(spark):
    rows = [(i, "http://m.example/", f"<body><article><p>Read our offer</p><h1>title {i}</h1><p>story {i} goes on</p></article></body>") for i in range(12)]
    assert texts_of(spark, rows) == {i: f"title {i}\n\nstory {i} goes on" for i in range(12)}


def test_html_copies_are_no_template(spark):
    copy = "<body><div><h1>The same title</h1><p>The same story</p></div></body>"
    rows = [(i, "http://c.example/", copy) for i in range(30)] + [(30 + i, "http://c.example/", f"<body><div><h1>title {i}</h1><p>story {i}</p></div></body>") for i in range(9)]
    rows += [(50 + i, "http://only.example/", copy) for i in range(10)]
    out = texts_of(spark, rows)
    assert all(out[i] == "The same title\n\nThe same story" for i in [*range(30), *range(50, 60)]) and out[30] == "title 0\n\nstory 0"


def test_template_decides_what_names_do_not_tell(spark):
    """By structure alone: nothing but the host's template tells the article from what is around it; without it, all stays."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want, free = [], {}, {}
    for i in range(20):
        top, story, more, end = line(4), [line(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 5))], line(rng.randrange(3, 9)), line(3)
        body = "".join(f"<p>{x}</p>" for x in story)
        rows.append((i, "http://s.example/x", f"<body><div class='a'><p>{more}</p></div><div class='b'><h1>{top}</h1><p>Read this first</p>{body}</div><div class='c'>{end}</div></body>"))
        want[i] = "\n\n".join([top, *story])
        free[i] = "\n\n".join([more, top, "Read this first", *story, end])
    assert texts_of(spark, rows) == want
    assert {i: html_text.page_text(html_text.parse(h), html_text.Template()) for i, _, h in rows} == free


def test_templates_equal_brute_force(spark):
    """Occurrence vectors, classes and nesting of random hosts, computed page by page."""
    rng = random.Random(12)
    names = ["a", "b", "c", "d"]

    def tree(depth):
        return "".join(f"<div class='{rng.choice(names)}'>{rng.choice(['', 'same', 'other', f'x{rng.random()}'])}{tree(depth - 1) if depth else ''}</div>" for _ in range(rng.randrange(1, 4)))

    shapes = [[tree(2) for _ in range(2)] for _ in range(4)]
    rows = [(f"h{h}", f"<body>{shapes[h][0]}{rng.choice(['', shapes[h][1], tree(1)])}<p>{rng.random()}</p></body>") for h in range(4) for _ in range(rng.randrange(1, 15))]
    got = {r["host"]: (set(r["texts"]), r["main"]) for r in html_text.templates(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()}
    want = {}
    for host in {h for h, _ in rows}:
        pages = {}
        for _, source in (r for r in rows if r[0] == host):
            p = html_text.parse(source)
            pages[html_text.page_key(p)] = {t[0]: t for t in html_text.page_tokens(p)}
        vectors = {t: tuple(p[t][3] if t in p else 0 for p in pages.values()) for t in {t for p in pages.values() for t in p}}
        sizes = {v: sum(w == v for w in vectors.values()) for v in vectors.values()}
        good = lambda v: sum(map(bool, v)) >= max(html_text.SUPPORT_PAGES, len(pages) / 2) and (sizes[v] >= 2 or all(v))
        own = [{"token": t, "up": x[1], "kind": x[2], "pages": sum(map(bool, v)), "total": sum(v), "open": sum(p[t][4] for p in pages.values() if t in p)} for t, v in vectors.items() if good(v) for x in [next(p[t] for p in pages.values() if t in p)]]
        if own:
            t = html_text.nested(own, len(pages))
            want[host] = (set(t.texts), t.main)
    assert got == want and any(texts for texts, _ in want.values())


@pytest.mark.parametrize(
    "page, want",
    [
        ("<main><h1>Head</h1><p>A long story that goes on and on</p><article>card</article></main>", "Head|A long story that goes on and on|card"),
        ("<div><p>A long story that goes on and on</p><article>card</article></div>", "A long story that goes on and on|card"),
        ("<div id='content' class='has-sidebar'><article><p>A long story</p><div class='share'>tell</div></article><div class='sidebar'>side</div></div>", "A long story"),
        ("<main><h1>Head</h1><div class='legal-guide'><article><p>A long story</p></article></div></main>", "A long story"),
        ("<div class='legal-guide'><h1>Head</h1><p>A long story</p></div><div class='ad'>buy</div>", "Head|A long story"),
        ("<div><p>story</p></div><div class='ad'>an advert that is longer</div><footer><p>much</p><p>more text than the story</p></footer>", "story"),
        ("<article><p>A long story</p></article><section id='comments'><article>me too</article></section>", "A long story"),
        ("<article><p>Hello <span class='ad'>Buy now</span> world <button>Press</button></p></article>", "Hello world"),
        ("<article><p>first <span class='share'>tell</p><p>second</p></article>", "first|second"),
        ("<article><section class='legal-history'><p>one</p></section><p class='side-effects'>two</p><div class='widget-free'>three</div></article>", "one|two|three"),
        ("<article><div class='share-buttons'>x</div><div class='ad-slot'>y</div><div hidden>z</div><label>l</label><div style='display: none'>w</div><p>one</p></article>", "one"),
        ("<div><p>A list of what we like:</p><ul><li><a href='/'>one long linked line</a><li><a>another linked line</a></ul></div>", "A list of what we like:|one long linked line|another linked line"),
    ],
)
def test_html_marks_and_wrappers(page, want):
    assert html_text.page_text(html_text.parse(f"<body>{page}</body>"), html_text.Template()) == want.replace("|", "\n\n")


@pytest.mark.parametrize("opening", ["<div class='a'>", "<b>", "<nav>", "<ul><li>", "<div>t"])
def test_deep_pages_take_time_by_their_length(opening):
    """60,000 open elements: paths and what is around them are numbers, so nothing grows with the depth of an element."""
    page = html_text.parse(opening * 60_000 + "<p>end")
    assert len(page.up) > 60_000 and len(html_text.page_tokens(page)) > 60_000
    text = html_text.page_text(page, html_text.Template(frozenset(), page.keys[-1]))
    assert text == "end" and html_text.page_text(page, html_text.Template()).endswith("" if opening == "<nav>" else "end")
    assert (html_text.page_text(page, html_text.Template()) == "") == (opening == "<nav>")


def test_tags_and_comments_without_end():
    text = lambda h: html_text.page_text(html_text.parse(h), html_text.Template())
    assert text("<p>one</p>" + "<a " * 200_000) == "one\n\n" + " ".join(["<a"] * 200_000)
    assert [text(h) for h in ("<p>a<!-- b <p>c", "<p>a<!-- b", "<p>a<![CDATA[b", "<p>a<![CDATA[b]]>c", "a<!-->b", "a < b", "a <b", "<p class='a/b'>x</p>y")] == ["a", "a", "ab", "abc", "a", "a < b", "a <b", "x\n\ny"]


def test_no_labelled_string_stands_in_the_corpus(spark):
    marked = {re.sub(r"^\{\w+:|\}$", "", m) for line in pii.LABELLED for m in re.findall(r"\{(?:email|phone|secret):[^}]*\}", line)}
    strings = marked | {m for line in pii.LABELLED for m in re.findall(r"[A-Za-z0-9_]{10,}", line)}
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").toLocalIterator():
        assert not [s for s in strings if s in row["text"]]


def test_secrets_and_spelt_addresses_outside_the_training_table():
    rng, model = random.Random(8), pii.train()
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"
    frames = ["the old house stood by the river . token = {} of the town", "we leave at dawn secret = {} and go on", 'api_key : "{}" was in the letter', "password : {} they said"]
    hits = total = 0
    for k in range(200):
        secret = [pick(hexes, 40), pick(hexes, 32), pick(hexes.upper(), 40), "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), pick(mixed, 36)][k % 5]
        text = frames[k % 4].format(secret)
        found = [(i, j) for kind, i, j in pii.find_spans([text], model)[0][1] if kind == "secret"]
        at = text.index(secret)
        hits += any(i <= at and at + len(secret) <= j for i, j in found)
        total += 1
    assert hits / total >= 0.9
    clean = ["the garden was green and the gate was open , page 12 of 300", "in 1984 there were 23 of them ; 4 left", "Das Haus am Fluss ist sehr alt und schön .", "version 3.2 costs 19.99 today"]
    assert all(not more for _, more in pii.find_spans(clean, model))
