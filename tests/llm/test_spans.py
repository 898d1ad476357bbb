"""Positions, sweeps and surroundings of personal data against plain Python, on texts with thousands of matches."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kinweave.llm import pii

SPAN_ROW = "doc_id int, spans array<struct<kind:string,start:bigint,end:bigint,match:string>>, taken array<struct<kind:string,start:bigint,end:bigint,match:string>>"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 700])
def test_running_folds(spark, size):
    values = [(i * 7919) % 101 - 20 for i in range(size)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    found = df.select(pii.running(F.col("v"), lambda a, x: a + x).alias("sums"), pii.running(F.col("v"), lambda a, x: F.greatest(a, x)).alias("tops")).first()
    assert found.sums == [sum(values[:i]) for i in range(size)]
    assert found.tops == [max([0, *values[:i]]) for i in range(size)]


def test_sweep_equals_pairwise_comparison(spark):
    draw = random.Random(5)
    rows = []
    for n in range(40):
        edges = sorted(draw.sample(range(400), 2 * draw.randint(0, 30)))
        spans = [("a", s, e, "m") for s, e in zip(edges[::2], edges[1::2])]
        starts = [draw.randrange(400) for _ in range(draw.randint(0, 20))]
        rows.append((n, spans, [("b", s, s + draw.randint(1, 25), "t") for s in starts]))
    found = spark.createDataFrame(rows, SPAN_ROW).select("doc_id", pii.clear_of(F.col("spans"), F.col("taken")).alias("x")).collect()
    for r in found:
        _, spans, taken = rows[r.doc_id]
        assert [tuple(s) for s in r.x] == [s for s in spans if not any(t[1] < s[2] and s[1] < t[2] for t in taken)]


def test_thousands_of_matches_in_one_text(spark):
    n = 3000
    text = " ".join(f"é mail us{i}@ex{i}.org or a{i} [at] b{i} [dot] com" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    pii.scan(docs.limit(0)).collect()
    begun = time.time()
    rows = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert time.time() - begun < 60
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [(s.start, s.end, s.match) for s in rows[1].base] == [(m.start(), m.end(), m.group()) for m in email.finditer(text)]
    assert len(rows[1].candidates) == n
    for c in rows[1].candidates:
        assert (text[c.start:c.end], text[max(0, c.start - pii.AROUND):c.start], text[c.end:c.end + pii.AROUND]) == (c.match, c.before, c.after)
    assert rows[2].base == rows[3].base == rows[2].candidates == rows[3].candidates == []
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}[1]
    assert len(spans) > n
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        assert s.start >= at
        out += [text[at:s.start], f"<{s.kind.upper()}>"]
        at = s.end
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "".join(out) + text[at:], 2: None, 3: ""}


def test_reliabilities_equal_a_plain_expectation_maximisation(spark):
    draw = random.Random(3)
    counted = {(k, tuple(draw.choice((-1, 0, 1)) for _ in pii.LABELERS)): draw.randint(1, 40) for k in ("email", "phone") for _ in range(25)}
    share = {key: 1 / (1 + math.exp(-1.5 * sum(key[1]))) for key in counted}
    for _ in range(12):
        nxt = {}
        for kind, votes in counted:
            mine = {v: (n * share[k, v], n * (1 - share[k, v])) for (k, v), n in counted.items() if k == kind}
            yes, no = (sum(x[side] for x in mine.values()) for side in (0, 1))
            odds = math.log((yes + 1) / (no + 1))
            for who, vote in enumerate(votes):
                y, m = (sum(x[side] for v, x in mine.items() if v[who] == vote) for side in (0, 1))
                odds += math.log((y + 1 + vote / 2) / (yes + 3)) - math.log((m + 1 - vote / 2) / (no + 3))
            nxt[kind, votes] = 1 / (1 + math.exp(-odds))
        share = nxt
    table = spark.createDataFrame([(k, list(v), n) for (k, v), n in counted.items()], "kind string, votes array<int>, n bigint")
    found = {(r.kind, tuple(r.votes)): r.p for r in pii.estimate(table).collect()}
    assert found.keys() == share.keys()
    assert all(abs(found[key] - share[key]) < 1e-9 for key in share)
