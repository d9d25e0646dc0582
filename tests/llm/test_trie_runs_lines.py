"""Operators 11 to 13 against brute force, on small tables and on odd ones."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsentry.llm import common, linededup, periodic, prefixtrie, queries

CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, n_lines string, key string, lang string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_conversations():
    """Shared openings, whole copies, prefixes of others, ties, NULLs, repeated rows, one long conversation."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), 1000, 1003, -5, -3, 77777]:
        n = rng.randrange(0, 10)
        if c % 7 == 0:
            n = 4
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hi" if t < 2 else rng.choice(["a", "bé", "", "long text"])))
    rows += [(61, None, "user", "null turn"), (61, None, None, None), (61, 0, "user", "first"), (61, 0, "assistant", "first"),
             (62, 1, None, "x"), (62, 1, None, "x"), (None, 1, "user", "no id"), (63, 0, "", "usera"), (64, 0, "user", "a")]
    rows += [(70, t, "user", f"t{t % 3}") for t in range(400)]
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        head = int(c / 5) * 5
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(turns) if c == head else tuple(own.get(head, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s in members:
        size = len(s[-1][1].encode()) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * size
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
                   sha(",".join(str(c) for c in sorted(m) if seqs[c] == s))) for s, m in members.items())


TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_value(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [8192, 3])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    rows = odd_conversations()
    df = spark.createDataFrame([r + ("x", 1) for r in rows], CONV + ", key string, depth int").repartition(5)
    got = [tuple(r) for r in prefixtrie.trie_of(df).select(*TRIE_COLUMNS).collect()]
    assert by_value(got) == by_value(brute_trie(rows))


def test_trie_sql_equals_brute_force():
    rows = odd_conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(TRIE_COLUMNS)} FROM ({prefixtrie.SQL})").fetchall()
    assert by_value(got) == by_value(brute_trie(rows))


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert prefixtrie.trie_of(spark.createDataFrame([], CONV)).count() == 0
    # all turns are skipped and the head of the group is missing
    c = next(c for c in range(1, 99) if c % 5 and prefixtrie.shared_turns(c) >= 2)
    got = prefixtrie.trie_of(spark.createDataFrame([(c, 0, "user", "a")], CONV)).select(*TRIE_COLUMNS).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_nodes_lead_back_to_their_turns(spark):
    df = spark.createDataFrame(odd_conversations(), CONV)
    rebuilt = common.scratch(prefixtrie.rebuild(df), "test-rebuilt")
    nodes = prefixtrie.trie(rebuilt)
    turns = prefixtrie.node_turns(nodes, rebuilt)
    assert turns.count() == nodes.where("depth > 0").count()
    texts = {(r.conv_id, r.pos): (r.role, r.text) for r in rebuilt.collect()}
    assert all(texts[r.conv_id, r.depth] == (r.role, r.text) for r in turns.collect())


def test_spread_join_salts_hot_keys_without_changing_the_result(spark):
    left = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    right = common.scratch(left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "test-spread")
    got = common.spread_join(left, right, ["k"], "n", ["id"])
    want = left.join(right.drop("n"), "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


# --- 12 periodic runs --------------------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                part = w[i:i + length]
                if not any(all(part[x] == part[x + s] for x in range(length - s)) for s in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    alphabet = draw(st.sampled_from([1, 2, 3, 6]))
    word = st.integers(0, alphabet)
    parts = draw(st.lists(st.tuples(st.lists(word, max_size=9), st.integers(1, 12)), max_size=6))
    return [x for unit, n in parts for x in unit * n]


@settings(max_examples=300, deadline=None)
@given(repetitive(), st.sampled_from([(24, 3), (6, 3), (10, 2)]))
def test_runs_equal_brute_force(words, limits):
    assert periodic.runs(words, *limits) == brute_runs(words, *limits)


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), max_size=5))
def test_stretches_leave_no_run_out(rows):
    import numpy as np

    first = np.cumsum([0] + [len(r) for r in rows])
    hashes = periodic.mix(np.array([x for r in rows for x in r], np.uint64) + np.uint64(3))
    got = collections.defaultdict(list)
    for r, a, b in periodic.stretches(hashes, first, 24, 3):
        got[r] += [(a + s, m, q) for s, m, q in periodic.runs(rows[r][a:b])]
    for r, words in enumerate(rows):
        assert sorted(got[r], key=lambda x: (x[0], x[2])) == brute_runs(words)


def brute_document(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    dropped = {x for s, m, q in found for x in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for x, w in enumerate(words) if x not in dropped)))


def test_periodic_runs_of_documents(spark):
    rng = random.Random(2)
    line = "the same line comes again and again. "
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, line * 9), (4, line * 9 + "Other words here. " + line * 9), (4, "É\x0bé É é " * 30),
            (5, "a " * 5000), (6, "x" * 9000), (7, "A a " * 40 + "a a " * 20), (8, "a\x85b a b " * 20)]
    rows += [(c, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 150)))) for c in range(10, 400)]
    rows += [(1000, " ".join(str(i % 4000) for i in range(60000)))]
    rows += [rows[3], rows[4]]
    df = spark.createDataFrame([r + (7, "y") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = [tuple(r) for r in periodic.digest(periodic.periodic_runs(df, order=periodic.rewritten)).collect()]
    small = [brute_document(*r) for r in rows if r[0] != 1000]
    assert by_value(r for r in got if r[0] != 1000) == by_value(small)
    assert sum(r[1] > 0 for r in small) > 20
    long = next(r for r in got if r[0] == 1000)
    assert zlib.crc32(b"1000") % 10 != 0 and long[1:6] == (1, 0, 60000, 4000, 15000)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_periodic_query_equals_brute_force_on_short_documents(spark):
    from ..conftest import SF_SMALL

    docs = {r.doc_id: r.text for r in common.read_documents(spark, SF_SMALL).collect()}
    for r in queries.op12_periodic_runs(spark, SF_SMALL).collect():
        if len((docs[r.doc_id] or "").split()) < 700:
            assert tuple(r) == brute_document(r.doc_id, docs[r.doc_id])


def test_a_run_of_a_very_long_text_takes_linear_room():
    n = 200000
    assert periodic.runs([i % 50000 for i in range(n)]) == [(0, n, 50000)]


# --- 13 lines ----------------------------------------------------------------------------------

def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, least=40, docs=5):
    where = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc_id)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in where.items() if len(k) >= least and len(v) >= docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return by_value(out)


def odd_lines():
    shared, other = "This line of the footer occurs in a great many documents.", "É" * 40
    rows = [(i, f"Own line {i}\n \t{shared.upper()}\x0b\r\n\n{shared}\nlast {i}") for i in range(1, 30)]
    rows += [(i, f"{other}\n{other.lower()}\n{other[1:]}x y\n") for i in range(40, 46)]
    rows += [(i, "four documents hold this line and that is not enough") for i in range(50, 54)]
    rows += [(i, "four documents and two rows without an id hold this line") for i in (54, 55, 56, 57, None, None)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared), (None, f"a\n{shared}"), (29, f"{shared}\n{shared}"), (29, f"{shared}\n{shared}")]
    rows += [(60, shared), (60, shared), (3, f"z\n{shared}"), (200, "\n".join([shared] + [f"{i} " + "n" * 40 for i in range(30000)] + [shared]))]
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = odd_lines()
    df = spark.createDataFrame([r + ("x", "y", None) for r in rows], DOC).repartition(4)
    out = linededup.dedup_lines(df)
    assert sorted(out.columns) == sorted(df.columns + ["n_dropped"])
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert by_value(tuple(r) for r in got) == brute_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_with_a_line_in_a_third_of_all_documents(spark):
    rows = [(i, f"own {i}\n" + ("A passage that very many documents have in common." if i % 3 == 0 else f"{i} " * 20)) for i in range(15000)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_value(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()) == brute_lines(rows)


def test_line_dedup_uses_built_in_functions_only(spark):
    from ..conftest import SF_SMALL

    plan = queries.op13_line_dedup(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
