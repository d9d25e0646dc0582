"""The training-data operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from flowsentry.llm import ann, chat, decontam, langid, lm, neardup, packing, quality, queries, toxicity, warc
from flowsentry.llm.bytewords import ALNUM_WORDS, WHITESPACE_WORDS, Words

from ..conftest import SF_ORACLE, SF_SMALL

LOW = {c: c + 32 for c in range(65, 91)}
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(name, sf=SF_SMALL):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


def run(spark, name, sf=SF_SMALL) -> pd.DataFrame:
    return queries.QUERIES[name](spark, sf).toPandas()


def odd_documents(spark):
    """NULLs in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n", "en", "s", 4), (4, long, "en", "s", len(long)),
            (5, "same words again and again here", "en", "s", 31), (5, "same words again and again here", "en", "s", 31),
            (None, "no id but words enough to make a shingle", "fr", None, 40), (6, "x" * 5000, None, "s", 5000),
            (7, "1234 5678 !!", "de", "s", 12), (8, "Same words AGAIN and again here", "en", "s", 31)]
    return spark.createDataFrame([r + ("t", 1.0, 9) for r in rows], DOC + ", size string, score double, node long")


# --- words -------------------------------------------------------------------------------------

@pytest.mark.parametrize("data, pattern", [(WHITESPACE_WORDS, r"[^\x20\x09-\x0D]+"),
                                           (ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_the_pattern(data, pattern):
    texts = ["", "Ab cD e\x0bf", " x y9_z \x1cq", "É é É", "a" * 3000 + " b", " lead", "trail "]
    raw = [t.encode() for t in texts]
    w = Words(b"".join(raw), np.cumsum([0] + [len(r) for r in raw]), data)
    want = [regex.findall(pattern, t.translate(LOW)) for t in texts]
    got = [[w.folded[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j])]
           for i, j in zip(w.row_first[:-1], w.row_first[1:])]
    assert got == want
    flat = [x for r in want for x in r]
    seen = {}
    for word, h in zip(flat, w.hashes().tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# --- 1 packing ---------------------------------------------------------------------------------

def test_encoder_gives_the_ids_of_the_json_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = np.random.default_rng(0)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in rng.integers(1, 0xD800, 3000)] + ["<|endoftext|> x", " \n\t ", "don't  stop"]
    for text, got in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert packing.encoder().encode_ordinary(text) == got.ids


def test_packing_gives_the_added_token_one_id(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a document <|endoftext|> and more", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext| > <|ENDOFTEXT|>",
             " \n<|endoftext|>\n\n", "no token", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.tokenize_pieces(docs, with_ids=True).collect()}
    assert got == {i: e.ids + [packing.EOD] for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}


def check_packing(p: pd.DataFrame, texts: list, max_len=2048):
    assert p.length.between(1, max_len).all()
    assert p.length.sum() == sum(len(packing.encoder().encode_ordinary(t or "")) + 1 for t in texts)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() <= max_len


def test_packing_holds_every_id_once(spark):
    d = table("documents")
    p = run(spark, "op1_packing")
    check_packing(p, d.text.tolist())
    for i, text in zip(d.doc_id, d.text):
        ids = np.array(packing.encoder().encode_ordinary(text) + [1], "<u4")
        for r in p[p.doc_id == i].itertuples():
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert p.length.sum() / p.sequence_id.nunique() / 2048 > 0.95


def test_packing_odd_rows_and_sequences(spark):
    docs = odd_documents(spark)
    packed = packing.pack(docs, 64, with_ids=True).cache()
    check_packing(packed.toPandas(), [r.text for r in docs.collect()], 64)
    seq = packing.sequences(packed, 64).toPandas()
    assert (seq.ids.str.len() == 64).all()
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_is_bounded_and_complete():
    rng = np.random.default_rng(1)
    hist = {int(k): int(v) for k, v in zip(range(1, 257), rng.integers(0, 10**9, 256))}
    plan = packing.plan_packs(hist, 256)
    for length, spans in plan.items():
        assert sum(s[1] for s in spans) == hist[length]
        assert packing.find_pack(spans, hist[length] - 1)[1] + length <= 256
    assert sum(map(len, plan.values())) < 256 * 3 * 256


# --- 2 chat ------------------------------------------------------------------------------------

def test_chat_round_trip_and_loss(spark):
    got = run(spark, "op2_chat_format").set_index("conv_id")
    rows = pd.concat([table("conversations"), pd.DataFrame(chat.PLANTED, columns=["conv_id", "turn", "role", "text"])])
    for conv, g in rows.sort_values("turn").groupby("conv_id"):
        said = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))
        loss = "".join(g.text[g.role == "assistant"])
        x = got.loc[conv]
        assert x.n_turns == len(g) and x.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("turns", [
    [("user", "### User: </turn>"), ("assistant", "<\\/turn> #\\## Assistant: \\"), ("assistant", "\n</turn>\n\n")],
    [(None, ""), ("", "a"), ("Assistant", "#### Tool: x"), ("r/o le\n", "é😀"), ("assistant", "  lead \n\n")],
    [("assistant", ""), ("assistant", "😀😀"), ("tool", "\\\\### ~: ")]])
def test_chat_escapes_are_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    out = chat.format_conversation(turns)
    assert chat.covered(out["mask"]) == [s for s in spans if s[0] < s[1]]


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1),
                                  (1, 1, "assistant", "", 1)], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_all(rows).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert chat.format_all(rows, digests=False).count() == 2
    assert chat.format_all(rows.limit(0)).count() == 0


# --- 3, 4, 5 classifiers -----------------------------------------------------------------------

def test_language_held_out(spark):
    got = run(spark, "op3_language_id", SF_ORACLE).merge(table("documents", SF_ORACLE)[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    h = got[got.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        m = langid.codewords(n)
        apart = [(m[a] != m[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 8)


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify(odd_documents(spark)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[4].lang_pred in ("en", "fr", "de")
    none = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(none.limit(0)).count() == 0
    kept = [r.doc_id for r in langid.keep_identified(odd_documents(spark)).collect()]
    assert {4, 5, 6, 8} <= set(kept) and not {1, 2, 3, 7} & set(kept)


def test_language_stage_keeps_what_it_cannot_judge(spark):
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = [r.doc_id for r in langid.keep_identified(unlabelled).collect()]
    assert sorted(x or 0 for x in kept) == [0, 4, 5, 5, 6, 8]
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    # a language of held-out rows only: the model never learns it
    rare = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & F.col("text").rlike("[A-Za-z]")
                      ).limit(40).withColumn("lang", F.lit("xx")).cache()
    kept = langid.keep_identified(docs.join(rare.select("doc_id"), "doc_id", "left_anti").unionByName(rare))
    assert kept.where("lang = 'xx'").count() == rare.count() > 0


def test_toxicity_held_out(spark):
    got = run(spark, "op5_toxicity", SF_ORACLE).merge(table("labels", SF_ORACLE), on="doc_id")
    h = got[got.held_out]
    assert ((h.predicted == 1) == (h.score >= 0.3)).all() and got.score.between(0, 1).all()
    clean, toxic = h[h.toxic == 0], h[h.toxic == 1]
    assert clean.predicted.mean() <= 0.05 and toxic.predicted.mean() >= 0.6
    assert toxic.score.mean() > clean.score.mean() + 0.3


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    rates = [(0.7, 0.02), (0.5, 0.05), (0.6, 0.01), (0.4, 0.03)]
    v = np.column_stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates])
    v = np.column_stack([v, v[:, 0]])       # a copy is fully correlated and must not count twice
    post, accuracy = toxicity.label_model(v, 0.3)
    assert ((post > 0.5) == y).mean() >= (v.any(axis=1) == y).mean() - 0.01 and accuracy.min() > 0.7
    alone, _ = toxicity.label_model(v[:, :4], 0.3)
    assert np.abs(post - alone).mean() < 0.05


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, None, 1), (None, 1, 1), (5, 0, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd_documents(spark), labels).toPandas()
    assert len(got) == 10 and got.score.between(0, 1).all()
    assert toxicity.score(odd_documents(spark).limit(0), labels.limit(0)).count() == 0
    assert toxicity.keep_clean(odd_documents(spark), labels.limit(0)).columns == odd_documents(spark).columns


def test_quality(spark):
    got = run(spark, "op4_quality", SF_ORACLE).merge(table("labels", SF_ORACLE), on="doc_id")
    assert (got.predicted == got.quality).mean() > 0.85
    odd = quality.score(odd_documents(spark)).toPandas()
    assert len(odd) == 10 and odd.score.between(0, 1).all()
    assert quality.score(odd_documents(spark).limit(0)).count() == 0


# --- 6 WARC ------------------------------------------------------------------------------------

def test_warc_records(spark):
    got = run(spark, "op6_warc_derivatives")
    pages = table("pages")
    assert got.warc_type.value_counts().to_dict() == {k: len(pages) for k in ("response", "metadata", "conversion")}
    source = got[got.warc_type == "response"].set_index("page_id").record_id
    derived = got[got.warc_type != "response"]
    assert (derived.refers_to.values == source.loc[derived.page_id].values).all() and got.record_id.is_unique
    for r in derived.head(40).itertuples():
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    assert not got[got.warc_type == "conversion"].block.str.contains("track\\(|<p>").any()


def test_warc_headers_and_odd_pages(spark):
    capture = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b: c\r\n\r\n<title>T &amp; u</title><p>a<br>b</p><!-- x <a href='/y'>"
    import json
    meta = json.loads(warc.derive(1, "http://h/x", capture, "d")[1][11])
    assert meta["response"]["headers"] == [["Content-Type", "text/html"], ["X-A", "b: c"]]
    assert meta["html"]["title"] == "T & u" and meta["html"]["links"] == []
    assert warc.plain_text("<p>1 < 2</p><script>no") == "1 < 2"
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1)],
                                 "page_id long, url string, html string, block int")
    assert warc.derivatives(rows).count() == 9 and warc.derivatives(rows.limit(0)).count() == 0
    record = warc.derive(1, "http://h/", "<p>x", "d")[2]
    assert warc.serialise(record, record[11].encode()).startswith(b"WARC/1.1\r\nWARC-Type: conversion\r\n")


def test_hostile_pages_take_linear_time():
    import time

    for part in ("<a ", "<html ", "<script ", "<title ", "<a href ", "<!--", "<img src=", '<a href="', "</div ", "&amp", "<style>"):
        start = time.time()
        warc.derive(1, "http://h/", part * (1_000_000 // len(part)), "d")
        assert time.time() - start < 3, part        # 0.02 to 0.5 s; a quadratic pattern takes hours
    assert [x["url"] for x in warc.links('<a x <a href=1 y="><a href="2>3"><img\nsrc=\'4\'><a> href=5<link href=6', "")] == ["1", "2>3", "4", "6"]


def test_warc_records_hold_their_blocks(spark):
    rows = spark.createDataFrame([(1, "http://h/", "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>é", "x"), (None, None, None, "x")],
                                 "page_id long, url string, html string, record string")
    got = {(r.page_id, r.warc_type): bytes(r.record) for r in warc.warc_records(rows).collect()}
    assert len(got) == 6
    for record in got.values():
        head, _, block = record.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and block[size:] == b"\r\n\r\n"
    assert got[1, "response"].partition(b"\r\n\r\n")[2][:-4].decode().endswith("<p>é")


# --- 7 near duplicates -------------------------------------------------------------------------

def brute_near(docs: pd.DataFrame) -> dict:
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = regex.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = collections.Counter()
    for v in index.values():
        for a in range(len(v)):
            for b in range(a + 1, len(v)):
                shared[v[a], v[b]] += 1
    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_brute_force(spark):
    d = table("documents")
    want = brute_near(d)
    for r in run(spark, "op7_near_duplicates").itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def chained_documents():
    """Groups around a base, chains whose ends are far apart, and a passage that unlike documents share."""
    rng = np.random.default_rng(9)
    rows, n = [], 100

    def words(k):
        return [f"v{x}" for x in rng.integers(0, 10**6, k)]

    for _ in range(4):
        base = words(80)
        for _ in range(12):
            w = list(base)
            w[int(rng.integers(0, 80))] = "edit%d" % rng.integers(10**6)
            rows.append((n, " ".join(w)))
            n += 1
        w = list(base)
        for _ in range(8):                      # a chain: each step changes the next three words
            at = 3 * len(rows) % 70
            w[at:at + 3] = words(3)
            rows.append((n, " ".join(w)))
            n += 1
    passage = words(70)
    for _ in range(60):
        rows.append((n, " ".join(words(20) + passage + words(20))))
        n += 1
    return rows


def test_near_duplicate_chains_and_shared_passages(spark):
    rows = chained_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicate_odd_rows(spark):
    docs = odd_documents(spark)
    got = neardup.near_duplicates(docs).toPandas()
    assert len(got) == 10 and got[got.doc_id == 8].component_id.tolist() == [5]
    assert got[got.doc_id.isin([1, 2, 3])].n_shingles.tolist() == [0, 0, 0]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_under_repeated_and_missing_ids(spark):
    a, b, z = ("one two three four five six %s" % w for w in ("seven", "of another kind", "and the last"))
    schema = "doc_id long, text string, lang string"

    def kept(rows):
        docs = spark.createDataFrame([r + ("en",) for r in rows], schema)
        return sorted((tuple(r)[:2] for r in neardup.keep_one(docs).collect()), key=repr)

    assert kept([(1, a), (5, b), (5, a)]) == sorted([(1, a), (5, b)], key=repr)
    assert kept([(1, a), (None, a), (None, b), (None, z)]) == sorted([(1, a), (None, b), (None, z)], key=repr)
    assert kept([(5, b), (5, a), (5, a), (5, b), (None, None), (None, None), (7, ""), (7, "")]) == sorted(
        [(5, a), (5, b), (None, None), (None, None), (7, ""), (7, "")], key=repr)
    rows = [(5, a), (5, b), (5, b), (None, b), (None, z), (3, b), (9, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {a: 5, b: 3, z: None}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((i, of[t]) for i, t in rows), key=repr)


def test_near_duplicate_chains_under_one_id(spark):
    """Representatives are found by row, so texts that all carry the same id are still compared."""
    rows = chained_documents()
    want = brute_near(pd.DataFrame(rows, columns=["doc_id", "text"]))
    groups = len({c for _, c in want.values()})
    docs = spark.createDataFrame([(None, t) for _, t in rows + rows[:40]], "doc_id long, text string")
    assert neardup.keep_one(docs).count() == groups


def test_classes_that_share_half_a_key_are_told_apart(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "c")], "k1 long, k2 long, x string")
    got = {r.x: r.node for r in neardup.told_apart(df).collect()}
    assert len(set(got.values())) == 3 and got["c"] == 2


# --- 8 language model --------------------------------------------------------------------------

def test_language_model_base_and_gain(spark):
    d = table("documents", SF_ORACLE)
    words = {i: regex.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + [None] for i, t in zip(d.doc_id, d.text)}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(c.values())
    floor = math.log10(total + len(c) + 1)
    got = run(spark, "op8_language_model", SF_ORACLE)
    for r in got.itertuples():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert abs(r.base_score - sum(math.log10(c[w] + 1) - floor for w in ws)) < 1e-6
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum() and (got.score < 0).all()


def test_unit_scores_do_not_depend_on_windows_or_slots(spark):
    counts = spark.createDataFrame([(int(lm.END.view(np.int64)), 0, 5)] + [(i * 7919, 97 + i % 20, 50 - i) for i in range(1, 40)],
                                   "key long, suffix int, c long")
    net = lm.Network(lm.vocabulary(counts, 16))
    rng = np.random.default_rng(0)
    net.flat += rng.normal(0, 0.2, net.flat.shape).astype(np.float32)
    docs = [np.append(rng.integers(0, lm.UNITS, n), 0).astype(np.int16) for n in (0, 1, 5, 70, 200, 3)]
    a, b = lm.score_units(net, docs, 3, 7), lm.score_units(net, docs, 64, 50)
    assert np.allclose(a, b, rtol=1e-4)
    # the factored softmax is a distribution
    h = rng.normal(size=(1, net.h)).astype(np.float32)
    mass = sum(np.exp(net.output(h, np.array([u]))[0]) for u in range(lm.UNITS))
    assert abs(mass - 1) < 1e-3


def test_gradient_of_the_recurrent_model(spark):
    """Against finite differences, in double precision, over a window with document starts and ended slots."""
    counts = spark.createDataFrame([(int(lm.END.view(np.int64)), 0, 5)] + [(i * 7919, 97 + i % 20, 50 - i) for i in range(1, 40)],
                                   "key long, suffix int, c long")
    net = lm.Network(lm.vocabulary(counts, 16))
    rng = np.random.default_rng(1)
    flat = net.flat.astype(np.float64) + rng.normal(0, 0.3, net.flat.shape)

    def at(values):
        net.flat = values
        place = 0
        for k, shape in net.shapes.items():
            net.p[k] = values[place:place + math.prod(shape)].reshape(shape)
            place += math.prod(shape)

    lay = lm.Layout([np.append(rng.integers(0, lm.UNITS, n), 0).astype(np.int16) for n in (9, 0, 4, 2, 6)], 3)
    place, live = next(lay.windows(12))
    fresh = lay.first[place]
    feed = lay.feed(place, fresh)
    start = rng.normal(size=(place.shape[1], net.h))
    at(flat.copy())
    _, g, _ = lm.gradient(net, start, lay.target[place], feed, fresh, live)
    grad = np.concatenate([g[k].reshape(-1) for k in net.shapes])
    some = np.flatnonzero(np.abs(grad) > 1e-6)
    some = np.concatenate([rng.choice(some, 150, replace=False), rng.choice(len(flat), 30)])
    for i in some:
        loss = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[i] += step
            at(moved)
            loss.append(lm.gradient(net, start, lay.target[place], feed, fresh, live)[0])
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[i], rel=1e-4, abs=1e-6)


def test_training_raises_the_score(spark):
    counts = spark.createDataFrame([(int(lm.END.view(np.int64)), 0, 5), (11, 97, 9), (12, 98, 3)], "key long, suffix int, c long")
    net = lm.Network(lm.vocabulary(counts, 16))
    doc = np.array([1, 2, 1, 1, 2, 0] * 30, np.int16)
    before = lm.score_units(net, [doc]).sum()
    lm.train(net, [doc] * 20, slots=4, window=10)
    assert lm.score_units(net, [doc]).sum() > before


def test_one_very_long_document_among_short_ones_holds_no_matrix(spark):
    import tracemalloc

    counts = spark.createDataFrame([(int(lm.END.view(np.int64)), 0, 5), (11, 97, 9), (12, 98, 3)], "key long, suffix int, c long")
    net = lm.Network(lm.vocabulary(counts, 16))
    docs = [np.zeros(200_000, np.int16)] + [np.zeros(50, np.int16)] * 600
    tracemalloc.start()
    lm.score_units(net, docs)
    lm.train(net, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6              # slots x longest document would be 100 MB for one byte a place


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("concat('w', id % 7, ' b ', repeat('a c ', int(id % 5)))").alias("text"))
    one, many = (lm.score_documents(docs.repartition(n)).orderBy("doc_id").collect() for n in (1, 9))
    assert np.allclose([r.score for r in one], [r.score for r in many], rtol=1e-6)


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id % 50, ' and more '), 300)").alias("text"))
    calls, fit = [], lm.fit

    def seen(train_docs, vocab, rounds):
        calls.append((train_docs, vocab, fit(train_docs, vocab, rounds)))
        return calls[-1][2]

    monkeypatch.setattr(lm, "fit", seen)
    got = lm.score_documents(docs).toPandas()
    (train_docs, vocab, (flat, tokens)), = calls
    assert train_docs.count() == (~got.held_out).sum() and tokens == got.train_tokens[0] > 1 << 20
    assert fit(train_docs.limit(50).coalesce(1), vocab, 2, block_tokens=5000)[1] == 50 * 901     # many blocks in one task


def test_blocks_hold_every_document_once():
    docs = [np.zeros(n, np.int16) for n in (3, 30, 1, 9, 4, 200, 2)]
    got = list(lm.blocks(iter(docs), 20))
    assert [len(b) for b in got] == [2, 5] and [id(d) for b in got for d in b] == [id(d) for d in docs]
    assert [len(b) for b in lm.blocks(iter(docs[:4] + docs[:2]), 20)] == [2, 4] and not list(lm.blocks(iter([]), 20))


def test_language_model_odd_rows(spark):
    got = lm.score_documents(odd_documents(spark)).toPandas()
    assert len(got) == 10 and got[got.doc_id == 1].n_tokens.tolist() == [1] and np.isfinite(got.score).all()
    assert lm.score_documents(odd_documents(spark).limit(0)).count() == 0


# --- 9 decontamination -------------------------------------------------------------------------

def brute_hits(docs, items, window=10):
    words = {}
    for i, t in items:
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            words.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        hit, found = set(), set()
        for size in {len(k) for k in words}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in words:
                    hit.update(range(k, k + size))
                    found |= words[tuple(w[k:k + size])]
        out.append((i, len(w), len(hit), len(found), decontam.items_digest(found), bool(hit)))
    return out


def test_decontamination_brute_force(spark):
    d, b = table("documents", SF_ORACLE), table("benchmark", SF_ORACLE)
    want = brute_hits(zip(d.doc_id, d.text), list(zip(b.item_id, b.text)))
    got = sorted(tuple(r) for r in queries.QUERIES["op9_decontamination"](spark, SF_ORACLE).collect())
    assert got == sorted(want) and any(x[5] for x in want)


def test_decontamination_spans_shards_and_odd_rows(spark):
    items = [(1, "one two three"), (2, "Two, THREE four five six seven eight nine ten eleven twelve"), (3, None), (4, "..."), (None, "zz")]
    b = spark.createDataFrame([i + (1,) for i in items], "item_id long, text string, n_hit int")
    docs = [(1, "x one-twoé two three. four"), (2, "ONE two; three four five six seven eight nine ten eleven twelve zz"),
            (3, None), (4, ""), (5, "é one two three")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r[0]: r[1:3] for r in brute_hits(docs, items)}
    for shard in (1, 4, 1000):
        got = {r.doc_id: r for r in decontam.scan(d, b, max_patterns=shard).collect()}
        assert {k: (r.n_words, r.n_hit) for k, r in got.items()} == want
        kept = decontam.decontaminate(d.withColumn("n_hit", F.lit("x")), b, max_patterns=shard)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if not v[1])
        assert kept.columns == ["doc_id", "text", "n_hit"]
    assert [docs[4][1][s.start:s.stop] for s in got[5].spans] == ["one two three"]
    assert got[2].item_ids == [1, 2]
    assert decontam.decontaminate(odd_documents(spark), b).count() == 10
    assert decontam.scan(d.limit(0), b).count() == 0 and decontam.scan(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_a_large_benchmark_is_scanned_in_slices_that_write_no_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(word, 30))) for i in range(150)]
    docs = [(i, " ".join([*rng.choice(word, 12), items[i % 150][1][int(rng.integers(0, 20)):], *rng.choice(word, 5)])
             if i % 3 else " ".join(rng.choice(word, 40))) for i in range(200)] + [(None, items[3][1]), (7, items[3][1]), (7, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = [tuple(r) for r in decontam.scan(d, b).collect()]
    written, scratch = [], decontam.scratch
    monkeypatch.setattr(decontam, "scratch", lambda df, tag: written.append(df.columns) or scratch(df, tag))
    parts = [tuple(r) for r in decontam.scan(d, b, max_patterns=300).collect()]
    assert sorted(map(repr, parts)) == sorted(map(repr, whole)) and sum(r[2] > 0 for r in whole) > 100
    assert decontam.decontaminate(d, b, max_patterns=300).count() == sum(r[2] == 0 for r in whole)
    assert len(written) > 20 and not any("text" in c for c in written)


# --- 10 nearest neighbours ---------------------------------------------------------------------

def test_nearest_neighbours_recall(spark):
    e = table("embeddings", "/root/testdata/sf0.1")
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.to_numpy()
    want = ann.brute_force(ids, x)
    got = run(spark, "op10_nearest_neighbours", "/root/testdata/sf0.1")
    recall = [len(set(g.vec_id) & set(want[q])) / 20 for q, g in got.groupby("query_id")]
    assert set(got.query_id) == set(want) and np.mean(recall) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    assert np.allclose(got.score, [x[place[q]] @ x[place[v]] for q, v in zip(got.query_id, got.vec_id)], atol=1e-12)
    for _, g in got.groupby("query_id"):
        order = g.sort_values("rank")
        assert order["rank"].tolist() == list(range(1, 21))
        assert list(zip(-order.score, order.vec_id)) == sorted(zip(-order.score, order.vec_id))


def test_nearest_neighbours_of_clustered_rows_read_a_small_share(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(250, 32))
    x = centres[rng.integers(0, 250, 10000)] + rng.normal(size=(10000, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = ann.brute_force(np.arange(10000), x)
    got = ann.nearest(df, leaves=128, share=0.025).toPandas()       # at most a quarter of the rows, overlaps included
    assert np.mean([len(set(g.vec_id) & set(want[q])) / 20 for q, g in got.groupby("query_id")]) >= 0.9


def test_nearest_neighbours_hot_vector_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, 0.0] if i % 3 else rng.normal(size=3).tolist(), 7) for i in range(600)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0, 0.0], 1), (1003, [float("nan"), 1.0, 1.0], 1),
             (1004, [1.0, None, 2.0], 1), (1005, [1.0, 2.0], 1), (1020, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows[:600]]
    want = ann.brute_force(np.array([i for i, _ in good]), np.stack([v for _, v in good]), every=20)
    got = ann.nearest(df, block=64).where("vec_id is not null").toPandas()
    recall = [len(set(g.vec_id) & set(want[q])) / 20 for q, g in got.groupby("query_id")]
    assert set(got.query_id) == set(want) and np.mean(recall) > 0.9
    few = ann.nearest(df.where("vec_id < 5")).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4] and ann.nearest(df.limit(0)).count() == 0


def test_nearest_neighbours_repeated_rows_hide_no_id(spark):
    rng = np.random.default_rng(6)
    hot = [1.0, 0.5, 0.0]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)] * 2
    rows += [(3, hot)] * 40 + [(9, [1.0, 0.5, j * 1e-3]) for j in range(1, 40)]      # one id over and over, alike and nearly so
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaves=1).toPandas()
    x = collections.defaultdict(list)
    for i, v in rows:
        x[i].append(v)
    assert not got.duplicated(["query_id", "vec_id"]).any()
    for q, g in got.groupby("query_id"):
        best = {i: max(np.dot(a, b) for a in x[q] for b in x[i]) for i in x if i != q}
        want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:20]
        assert g.sort_values("rank").vec_id.tolist() == want


def test_equal_vectors_tie_exactly_in_any_place():
    rng = np.random.default_rng(4)
    q, one = rng.normal(size=(3, 61)), rng.normal(size=61)
    x = np.stack([one if i % 2 else rng.normal(size=61) for i in range(77)])
    c = np.arange(1, 77, 2)
    for i in range(3):
        assert len(set(ann.pair_products(q, x, np.full(len(c), i), c, 7))) == 1
    assert np.allclose(ann.pair_products(q, x, np.array([2, 0]), np.array([5, 6])), [q[2] @ x[5], q[0] @ x[6]])


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    d, b = table("documents"), table("benchmark")
    full = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(full, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect() if r.predicted}
    left = d[~d.doc_id.isin(toxic)]
    lang = {r.doc_id: r for r in langid.identify(spark.createDataFrame(left)).collect()}
    left = left[[lang[i].lang_pred != "und" and (lang[i].ambiguous or lang[i].score < 0.95 or lang[i].lang_pred == said)
                 for i, said in zip(left.doc_id, left.lang)]]
    near = brute_near(left)
    left = left[[near[i][1] == i for i in left.doc_id]]
    dirty = {r[0] for r in brute_hits(zip(left.doc_id, left.text), list(zip(b.item_id, b.text))) if r[5]}
    left = left[~left.doc_id.isin(dirty)]
    assert set(got.doc_id) == set(left.doc_id)
    check_packing(got, left.text.tolist())
    assert len(left) > 0.6 * len(d) and len(dirty) > 0


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
