"""Plain versions of the pack plan, the quality votes and label model, and the pages' records."""

import json
import math
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsentry.llm import packing, warc

from .test_operators import run, table


# --- 1 packing -----------------------------------------------------------------------------------

def plain_shortest_pack_first(lengths, max_len):
    """Piece by piece, longest first, into the emptiest pack; a new pack where that has no room."""
    fills = []
    for x in sorted(lengths, reverse=True):
        k = min(range(len(fills)), key=fills.__getitem__, default=None)
        if k is None or fills[k] + x > max_len:
            fills.append(x)
        else:
            fills[k] += x
    return sorted(fills)


@settings(max_examples=200, deadline=None)
@given(st.integers(8, 40).flatmap(lambda m: st.tuples(st.just(m), st.lists(st.integers(1, m), max_size=80))))
def test_plan_fills_packs_as_the_plain_method_does(case):
    max_len, lengths = case
    plan = packing.plan_packs(dict(Counter(lengths)), max_len)
    fills, taken = Counter(), Counter()
    for length, n in Counter(lengths).items():
        for rank in range(n):
            pack, offset = packing.find_pack(plan[length], rank)
            fills[pack] += length
            taken[pack, offset] += 1
    assert sorted(fills.values()) == plain_shortest_pack_first(lengths, max_len)
    assert max(taken.values(), default=1) == 1


def test_pieces_without_ids_spread_over_salts(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    got = packing.pack(docs, 64).toPandas()
    assert len(got) == 3000 and not got.duplicated(["sequence_id", "offset"]).any()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.values == np.concatenate([[0], np.cumsum(part.length.values)[:-1]])).all()
        assert part.length.sum() <= 64


# --- 4 quality -----------------------------------------------------------------------------------

def plain_votes(text):
    raw = (text or "").encode()
    words = raw.lower().split()
    kinds = Counter("lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else
                    "high" if b >= 128 else "symbol" for b in raw if b > 32)
    solid, n = max(sum(kinds.values()), 1), len(words)
    letters = max(kinds["lower"] + kinds["upper"] + kinds["high"], 1)
    size, bangs = solid / max(n, 1), raw.count(b"!") / max(n, 1)
    seen = Counter(words)
    variety, top = (len(seen) / n, max(seen.values()) / n) if n else (0.0, 0.0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    share = {k: v / solid for k, v in kinds.items()}

    def vote(good, bad):
        return 1 if good else -1 if bad else 0

    return (vote(n >= 40, n < 8), vote(3 < size < 10, size < 2 or size > 15),
            vote(kinds["upper"] / letters < 0.15, kinds["upper"] / letters > 0.3),
            vote(share.get("symbol", 0) < 0.07, share.get("symbol", 0) > 0.12),
            vote(share.get("digit", 0) < 0.05, share.get("digit", 0) > 0.2), vote(bangs < 0.02, bangs > 0.1),
            vote(n >= 20 and variety > 0.35, n >= 20 and variety < 0.2),
            vote(n >= 20 and top < 0.12, n >= 20 and top > 0.25), vote(repeated < 0.1, repeated > 0.3))


def plain_label_model(votes):
    """Posterior of each distinct vote row by EM, one sum at a time."""
    counts = Counter(votes)
    post = {v: 1 / (1 + math.exp(-2.0 * (sum(v) - 0.4 * len(v)))) for v in counts}
    for _ in range(100):
        table_ = {}
        for c in (0, 1):
            for j in range(9):
                sums = {x: 0.1 + sum(n * (post[v] if c else 1 - post[v]) for v, n in counts.items() if v[j] == x) for x in (-1, 0, 1)}
                for x in sums:
                    table_[c, j, x] = sums[x] / sum(sums.values())
        prior = min(max(sum(post[v] * n for v, n in counts.items()) / len(votes), 1e-3), 1 - 1e-3)
        now = {}
        for v in counts:
            odds = sum(math.log(table_[0, j, x]) - math.log(table_[1, j, x]) for j, x in enumerate(v)) + math.log((1 - prior) / prior)
            now[v] = 1 / (1 + math.exp(min(max(odds, -30), 30)))
        done = max(abs(now[v] - post[v]) for v in counts) < 1e-6
        post = now
        if done:
            break
    return post


def test_quality_votes_and_posteriors(spark):
    docs = table("documents")
    got = run(spark, "op4_quality").merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(docs)
    votes = [plain_votes(t) for t in got.text]
    assert [sum(x > 0 for x in v) for v in votes] == got.votes_good.tolist()
    assert [sum(x < 0 for x in v) for v in votes] == got.votes_bad.tolist()
    post = plain_label_model(votes)
    assert np.allclose(got.posterior, [post[v] for v in votes], atol=1e-5)
    # the scorer, which never sees the votes, agrees with the posterior labels it learned from
    sure = (got.posterior - 0.5).abs() > 0.4
    assert ((got.score >= 0.5) == (got.posterior >= 0.5))[sure].mean() > 0.95


# --- 6 WARC --------------------------------------------------------------------------------------

class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = 0

    def handle_starttag(self, tag, attrs):
        wanted = ("a", "link", "img", "script", "iframe")
        self.found += tag in wanted and any(k in ("href", "src") and v is not None for k, v in attrs)

    handle_startendtag = handle_starttag


def test_every_record_of_every_page(spark):
    pages = table("pages").set_index("page_id")
    got = run(spark, "op6_warc_derivatives")
    by = {k: part.set_index("page_id") for k, part in got.groupby("warc_type")}
    assert set(by) == {"response", "metadata", "conversion"}
    for page, row in pages.iterrows():
        capture = row.html or ""
        raw, body = capture.encode(), warc.split_capture(capture)[2]
        response = by["response"].loc[page]
        assert response.block_digest == warc.digest(raw) and response.content_length == len(raw)
        assert response.payload_digest == warc.digest(body.encode())
        plain = Links()
        plain.feed(body)
        plain.close()
        for kind in ("metadata", "conversion"):
            r = by[kind].loc[page]
            data = r.block.encode()
            assert r.refers_to == response.record_id and r.payload_digest == response.payload_digest
            assert r.block_digest == warc.digest(data) and r.content_length == len(data) and r.n_links == plain.found
        meta = json.loads(by["metadata"].loc[page].block)
        assert meta["envelope"]["record-id"] == response.record_id and meta["envelope"]["block-digest"] == response.block_digest
        assert len(meta["html"]["links"]) == plain.found
