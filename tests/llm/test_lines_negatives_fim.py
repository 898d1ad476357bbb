"""Line index, hard negatives and fill-in-middle against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import fim, lines, negatives

WHITE = " \t\n\x0b\x0c\r"
LOWER = {i: chr(i + 32) for i in range(65, 91)}


# --- lines ---------------------------------------------------------------------------------

def dropped_by_hand(rows, least=10):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    owners = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(lines.LAST_ID if i is None else i)
    out = []
    for i, t in rows:
        given = (t or "").split("\n")
        own = lines.LAST_ID if i is None else i
        kept = [x for x in given if not (len(key(x)) >= least and len(owners[key(x)]) > 1 and min(owners[key(x)]) < own)]
        out.append((i, "\n".join(kept), len(given), len(given) - len(kept)))
    return out


LINES = [(1, None), (2, ""), (3, "Hello World again\nshort\n  HELLO world AGAIN\t"), (4, "hello world again\n\nx"), (None, "hello world again\nonly without id"),
         (None, "only without id\nfoo"), (4, "hello world again\n\nx"), (3, "hello world again"), (9, "éééééééééé\n" * 3), (8, "éééééééééé"), (7, "ééééééééé"),
         (6, "ééééééééé"), (10, "ÉÉÉÉÉÉÉÉÉÉ"), (11, "\x0b\x0c hello world again \r\n\n"), (12, "x" * 300000 + "\nhello world again"), (13, "x" * 300000)]


@pytest.mark.parametrize("shard_keys, block", [(1 << 15, 1 << 18), (2, 50)])
def test_lines_lose_what_others_hold(spark, monkeypatch, shard_keys, block):
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(lines, "BLOCK_PROBES", block)
    # a hot line in every document, and repeats of it within one
    rows = LINES + [(100 + i, "a line that is very common\nown line number %d\n" % i * 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for c in ("owner", "rest", "n_lines", "ordinals", "place"):
        docs = docs.withColumn(c, F.lit("kept"))
    found = lines.drop_repeated(docs)
    assert {"owner", "rest", "ordinals", "place"} < set(found.columns) and found.where("place <> 'kept' or rest <> 'kept'").count() == 0
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()]
    assert sorted(got, key=str) == sorted(dropped_by_hand(rows), key=str)


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert lines.drop_repeated(empty).count() == 0
    unlike = spark.createDataFrame([(1, "one line of its own"), (2, "another line of its own")], "doc_id bigint, text string")
    assert {(r.text, r.n_dropped) for r in lines.drop_repeated(unlike).collect()} == {("one line of its own", 0), ("another line of its own", 0)}


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_the_hash_is_minimal_and_perfect(n):
    made = np.random.default_rng(n).integers(0, 1 << 63, (2, n)).astype(np.uint64)
    place, mark = made[0] % np.uint64(50), made[1]  # many keys share the half that places them
    index = lines.PerfectHash(*lines.PerfectHash.build(place, mark)).index(place, mark)
    assert sorted(index.tolist()) == list(range(n))


def test_key_hashes_are_those_of_the_keys():
    keys = ["", "a", "ab", "ba", "a" * 1000, "a" * 1001, "é", "ab"]
    place, mark = lines.KeyHasher()(pa.array(["ignored", *keys])[1:])
    assert place[2] == place[7] and mark[2] == mark[7]
    assert len(set(zip(place.tolist(), mark.tolist(), strict=True))) == len(set(keys))


# --- hard negatives ------------------------------------------------------------------------

def mined_by_hand(rows, every, k=5, percent=80):
    usable = [(i, g, [int(np.floor(256 * x)) for x in v]) for i, g, v in rows
              if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, g, v) in enumerate(usable):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, h) for m, (j, h, w) in enumerate(usable) if m != n and len(w) == len(v)]
        scored.sort()
        for s, j, _ in [x for x in scored if x[2] == g][:k]:
            fits = [x for x in scored if x[2] != g and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return out


def vectors(kind, n=900, size=12):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        centres = rng.normal(size=(6, size)) * 4
        made = [(centres[i % 6] + rng.normal(size=size) * 0.02).tolist() for i in range(n)]
        return [(i, i % 4, v) for i, v in enumerate(made)]
    if kind == "ties":  # few distinct vectors, repeated ids, one label with most rows
        made = rng.integers(-1, 2, (n, 3)).astype(float)
        return [(i // 2 * 2, 0 if i % 3 else i % 5, v.tolist()) for i, v in enumerate(made)]
    odd = [(None, 1, [1.0] * size), (5000, None, [1.0] * size), (5010, 1, None), (5020, 1, [None] + [1.0] * (size - 1)), (5030, 1, [float("nan")] * size),
           (5040, 1, [float("inf")] * size), (5050, 1, []), (5060, 2, []), (5070, 1, [0.0] * size), (5080, 1, [1.0, 2.0]), (5090, 2, [1.0, 2.0]), (5100, 1, [1.0, 2.0])]
    return [(i, int(rng.integers(0, 3)), rng.normal(size=size).tolist()) for i in range(n)] + odd


@pytest.mark.parametrize("kind", ["clustered", "ties", "odd"])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 200)
    monkeypatch.setattr(negatives, "TILE_ROWS", 64)
    rows = vectors(kind)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, label int, embedding array<double>, uid int, block int").repartition(4)
    got = [tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(mined_by_hand(rows, 10))


def test_no_vectors(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], schema), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_spare_rows_where_anchors_lie_close():
    rows = [(i, g, np.floor(256 * np.array(v)).astype(int)) for i, g, v in vectors("clustered", 600)]
    block = negatives.Block.__new__(negatives.Block)
    block.uid = block.ids = np.arange(len(rows))
    block.label, block.v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    some = negatives.Block.__new__(negatives.Block)
    at = np.arange(0, 600, 10)
    some.uid = some.ids = at
    some.label, some.v, some.windows = block.label[at], block.v[at], [None] * len(at)
    order, parent = negatives.spanning_tree(some.v)
    some.order, some.parent = order.tolist(), parent.tolist()
    counts = {}
    list(negatives.tile(some, block, 0, 600, 5, 80, counts))
    assert counts["scored"] < 0.2 * counts["pairs"]


def test_scores_beyond_what_doubles_hold_are_exact():
    big = (1 << 30) - 1
    v = np.array([[big, 1], [big, 0], [big, 2], [1, big]], np.int64)
    block = negatives.Block.__new__(negatives.Block)
    block.uid = block.ids = np.arange(4)
    block.label, block.v, block.windows = np.zeros(4, int), v, [None] * 4
    order, parent = negatives.spanning_tree(v)
    block.order, block.parent = order.tolist(), parent.tolist()
    found = {int(at): (chosen.tolist(), score.tolist()) for at, _, chosen, score in negatives.tile(block, block, 0, 4, 2, 80)}
    exact = lambda a, b: int(v[a, 0]) * int(v[b, 0]) + int(v[a, 1]) * int(v[b, 1])
    for a in range(4):
        want = sorted((-exact(a, b), b) for b in range(4) if b != a)[:2]
        assert found[a] == ([b for _, b in want], [-s for s, _ in want])


# --- fill in middle ------------------------------------------------------------------------

TEXTS = [None, "", "a", "\n", "a\n", "a\nb", "\n\n\n", "x<P>y\nz", "é\n<\nP>\nzz", "a\r\nb\x0c\n", "q" * 200000, "ab\n" * 50000, "a\nb", "<S>", " x\u0085y\n\x00"]


def rearranged_by_hand(i, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 100)])
def test_documents_are_cut_and_rebuilt(spark, rate, spm):
    rows = [(i, t) for n in range(40) for i, t in [(n, TEXTS[n % len(TEXTS)])]] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (-5, "a\nb\nc")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("output", F.lit("x")).withColumn("n", F.lit("y")).withColumn("_draws", F.lit(3))
    made = fim.transform(table, rate=rate, spm=spm, restored="restored")
    assert made.columns == ["doc_id", "_draws", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
    assert sorted(got, key=str) == sorted([(i, t or "", *rearranged_by_hand(i, t, rate, spm)) for i, t in rows], key=str)
    assert made.where("restored <> text or restored is null").count() == 0
    assert fim.restore(made.drop("restored")).where("restored <> text").count() == 0


def test_no_documents(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
