"""Set sharing, skew helpers, hit tables and graphs against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.functions.hypergeom import log_upper_tail
from kinweave.operators import graph as G
from kinweave.operators import hits as H
from kinweave.operators import sharing as S
from kinweave.operators import sketch
from kinweave.operators.skew import first_by, matched, pairs_within, running_total, with_ordinal
from kinweave.plans.classify import classify_new
from kinweave.plans.graphs import sketch_graph
from kinweave.plans.params import WorkflowParams


def exact_tail(c, a, b, u):
    return sum(math.comb(a, k) * math.comb(u - a, b - k) for k in range(c, min(a, b) + 1)) / math.comb(u, b)


def test_tail_matches_exact_sums(spark):
    cases = [(1, 1, 1, 10), (1, 3, 4, 7), (2, 5, 5, 6), (3, 10, 20, 100), (40, 50, 60, 1000), (7, 7, 7, 7),
             (1, 30, 900, 1000), (100, 150, 120, 5000), (2, 3, 3, 1_000_000_000)]
    df = spark.createDataFrame(cases, "c bigint, a bigint, b bigint, u bigint")
    rows = df.withColumn("t", log_upper_tail(*[F.col(x) for x in "cabu"])).collect()
    for r in rows:
        want = exact_tail(r.c, r.a, r.b, r.u)
        assert r.t == pytest.approx(math.log(want), rel=1e-9, abs=1e-9)


def random_sets(seed, n_sets=25, n_items=30):
    rng = random.Random(seed)
    return {f"s{i:02d}": {f"p{j}" for j in rng.sample(range(n_items), rng.randint(1, 12))} | {"hot"} for i in range(n_sets)}


def presence(spark, sets):
    return spark.createDataFrame([(s, p) for s, items in sets.items() for p in items], "query string, target string")


def test_edges_against_brute_force(spark):
    sets = random_sets(1)
    kept = {s: items - {"hot"} for s, items in sets.items()}
    universe = len(set().union(*kept.values()))
    want = {}
    for x, y in itertools.combinations(sorted(kept), 2):
        c = len(kept[x] & kept[y])
        p = exact_tail(c, len(kept[x]), len(kept[y]), universe) if c else 1.0
        if c and p <= 0.1:
            want[x, y] = -math.log10(p)
    got = {(r.source, r.target): r.weight for r in S.hypergeom_edges(presence(spark, sets)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    ratio = {(r.source, r.target): r.weight for r in S.hypergeom_edges(presence(spark, sets), weight="ratio").collect()}
    assert ratio == {(x, y): pytest.approx(len(kept[x] & kept[y]) / min(len(kept[x]), len(kept[y]))) for x, y in want}


def test_no_item_left_gives_no_edge(spark):
    pa = spark.createDataFrame([(f"s{i}", "only") for i in range(5)], "query string, target string")
    assert S.hypergeom_edges(pa).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocked_pairs_are_all_pairs_once(spark, block):
    rows = [("hot", i) for i in range(23)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int").withColumn("w", F.col("id") * 10)
    got = [(r.g, r.i, r.j, r.w_i, r.w_j) for r in pairs_within(df, ["g"], "id", ["w"], block=block).collect()]
    want = [(g, i, j, 10 * i, 10 * j) for g, n in (("hot", 23), ("cold", 3)) for i, j in itertools.combinations(range(n), 2)]
    assert sorted(got) == sorted(want)


def test_ordinals_are_dense_and_totals_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("k"))
    out = with_ordinal(df, ["k"], ["g"]).groupBy("g").agg(
        F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in out)
    totals = running_total(df, ["g"], F.floor(F.col("k") / 100), ["k"], F.col("k"), "before").where("not g").orderBy("k").collect()
    seen = 0
    for r in totals:
        assert r.before == seen
        seen += r.k


def test_first_by_is_a_total_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("b", 2, 9)], "k string, o int, v int")
    assert sorted(first_by(df, ["k"], [F.col("o")]).collect()) == [("a", 1, 4), ("b", 2, 9)]


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[0] * r[1], r[2], r[3], r[0], r[1])):
        if not any(r[2] < k[3] and k[2] < r[3] for k in kept):
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("group_rows", [1000, 50, 0])
def test_overlap_filter_with_reverse_hits(spark, group_rows):
    rng = random.Random(5)
    groups = {}
    for pair in (("q", "hot"), ("q", "t"), ("r", "t")):
        n = 300 if pair[1] == "hot" else 20
        rows = set()
        while len(rows) < n:
            start, length = rng.randint(1, 80), rng.randint(1, 15)
            s, e = (start, start + length) if rng.random() < 0.8 else (start + length, start)
            rows.add((round(rng.uniform(50, 100), 2), length, s, e))
        groups[pair] = sorted(rows)
    df = spark.createDataFrame([(*p, *r) for p, rows in groups.items() for r in rows],
                               "query string, target string, pident double, alnlen int, qstart int, qend int")
    got = {}
    for r in H.greedy_overlap_filter(df, group_rows).collect():
        got.setdefault((r.query, r.target), []).append((r.pident, r.alnlen, r.qstart, r.qend))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(v) for k, v in groups.items()}


@pytest.mark.parametrize("group_rows", [1000, 0])
def test_overlap_filter_on_ties_nulls_and_nothing(spark, group_rows):
    schema = "query string, target string, pident double, alnlen int, qstart int, qend int, more string"
    rows = [(None, "t", 90.0, 10, 1, 11, "b"), (None, "t", 90.0, 10, 1, 11, "a"), (None, None, 50.0, 10, 5, 5, "x"), ("q", "t", 10.0, 1, 1, 1000000, "long"),
            ("q", "t", 90.0, 10, 10, 20, "y"), ("q", "t", 90.0, 10, 20, 30, "z"), ("q", "t", 80.0, 10, 25, 15, "back"), ("q", "t", 80.0, 10, 25, 15, "back")]
    kept = H.greedy_overlap_filter(spark.createDataFrame(rows, schema), group_rows).collect()
    assert sorted(r.more for r in kept) == ["a", "back", "back", "x", "y", "z"]
    assert H.greedy_overlap_filter(spark.createDataFrame([], schema), group_rows).count() == 0


def test_loops_only_and_empty_graphs(spark):
    loops = spark.createDataFrame([("a", "a", 2.0), ("b", "b", 3.0)], "source string, target string, weight double")
    assert sorted(G.symmetrize_with_loops(loops).collect()) == [("a", "a", 3.0), ("b", "b", 3.0)]
    empty = loops.where("false")
    assert G.symmetrize_with_loops(empty).count() == 0
    assert G.symmetrize_with_loops(empty, empty="dummy").collect() == [("_dummy", "_dummy", 1.0)]


def test_flat_weights_rescale(spark):
    edges = spark.createDataFrame([("a", "b", 0.7), ("b", "c", 0.7), ("c", "d", None)], "source string, target string, weight double")
    assert [r.weight for r in G.minmax_rescale(edges).orderBy("source").collect()] == [1.0, 1.0, None]


def test_cover_rounds(spark):
    pa = presence(spark, {"a": {"x", "y"}, "b": {"x"}, "c": {"z"}, "d": {"u", "v"}, "e": {"w"}})
    picks = S.hallmark_items(pa, 2).orderBy("round", "position").collect()
    assert [(r.round, r.target, r.freq) for r in picks][:2] == [(0, "x", 2), (0, "u", 1)]
    covered = {r.target for r in picks}
    assert all(covered & items for items in ({"x", "y"}, {"x"}, {"z"}, {"u", "v"}, {"w"}))


def covering(rows, top_n):
    """The greedy cover on (set, item) rows, round by round; sets without a name are never covered, items without one end it."""
    picks, turn = [], 0
    while rows:
        freq = Counter(item for _, item in rows)
        top = sorted(freq, key=lambda i: (-freq[i], i is not None, i or ""))[:top_n]
        picks += [(turn, n, i, freq[i]) for n, i in enumerate(top)]
        met = {s for s, i in rows if i in top and i is not None}
        rows = [] if None in top else [(s, i) for s, i in rows if (s is None or s not in met) and i not in top and i is not None]
        turn += 1
    return picks


@pytest.mark.parametrize("items, rows", [(1 << 18, 1 << 21), (9, 1 << 21), (1 << 18, 60), (2, 1)])
def test_cover_plays_rounds_in_one_task(spark, monkeypatch, items, rows):
    rng = random.Random(8)
    pairs = [(f"s{s:03d}", f"p{int(rng.expovariate(0.05))}") for s in range(120) for _ in range(rng.randint(1, 4))]
    pairs += [(None, "p1"), (None, "only"), ("s001", None), ("s002", "p3"), ("s002", "p3")]
    written, path = [], S.scratch_path
    monkeypatch.setattr(S, "scratch_path", lambda session, label: written.append(label) or path(session, label))
    monkeypatch.setattr(S, "COVER_ITEMS", items)
    monkeypatch.setattr(S, "COVER_ROWS", rows)
    got = sorted(tuple(r) for r in S.hallmark_items(spark.createDataFrame(pairs, "query string, target string"), 3).collect())
    want = covering(pairs, 3)
    assert got == want and want[-1][0] >= 8
    if items > 1000 and rows > 1000:
        assert written.count("cover") == 2  # one write for the first round, one for all others


def test_cover_of_items_without_a_name_ends(spark):
    pairs = [("a", None), ("b", None), ("c", "x"), ("d", "y")]
    got = sorted(tuple(r) for r in S.hallmark_items(spark.createDataFrame(pairs, "query string, target string"), 1).collect())
    assert got == [(0, 0, None, 2)]


def test_join_of_keys_that_are_hot_on_both_sides(spark):
    left = spark.createDataFrame([("hot", n) for n in range(50)] + [("a", 50), ("only left", 51), (None, 52)], "key string, l int")
    right = spark.createDataFrame([("hot", n) for n in range(40)] + [("a", 40), ("a", 41), ("only right", 42), (None, 43)], "key string, r int")
    got = sorted((r.key, r.l, r.r) for r in matched(left, right, "key", "l", "r", block=8).collect())
    assert got == sorted([("hot", i, j) for i in range(50) for j in range(40)] + [("a", 50, 40), ("a", 50, 41)])


def test_exact_sketches_give_the_containments(spark):
    records = spark.createDataFrame([("g.1 x", "abcdefgh"), ("h.1", "abcdefzz"), ("i.1", "q")], "id string, seq string")
    sets = sketch.kmer_sets(records, 3)
    found = {(r.Query_name, r.Ref_name): (r.Align_fraction_query, r.Align_fraction_ref) for r in sketch.sketch_ani(sets, sets, 3).collect()}
    assert found["g.1 x", "h.1"] == (pytest.approx(400 / 6), pytest.approx(400 / 6)) and ("i.1", "i.1") not in found
    edges = sketch_graph(records, WorkflowParams(sketch_k=3)).collect()
    j = 4 / 8
    assert [(r.source, r.target) for r in edges] == [("g", "h")]
    assert edges[0].weight == pytest.approx((1 + math.log(2 * j / (1 + j)) / 3) * 4 / 6)


def test_pairs_of_one_collection_come_once(spark):
    records = spark.createDataFrame([("g.1 x", "abcdefgh"), ("h.1", "abcdefzz"), ("i.1", "q"), ("h.2", "abcdxy"), (None, "abcd")], "id string, seq string")
    sets = sketch.kmer_sets(records, 3)
    both = {tuple(r)[2:] for r in sketch.sketch_ani(sets, sets, 3).where("Query_name < Ref_name").collect()}
    once = sketch.sketch_ani(sets, None, 3).collect()
    assert {tuple(r)[2:] for r in once} == both and len(once) == len(both) == 3
    largest = max(r.ANI * max(r.Align_fraction_query, r.Align_fraction_ref) / 10000 for r in once if r.Query_name == "g.1 x")
    assert [tuple(r) for r in sketch_graph(records, WorkflowParams(sketch_k=3)).collect()] == [("g", "h", pytest.approx(largest))]


def test_new_genomes_must_be_unique(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "source string, target string, weight double")
    items = spark.createDataFrame([("a.1", "g"), ("b.1", "g")], "query string, target string")
    meta = spark.createDataFrame([("a", "F")], "Accession string, Family string")
    twice = spark.createDataFrame([("b.1",), ("b.2",)], "query string")
    with pytest.raises(ValueError):
        classify_new(items, items, [edges, edges], meta, twice, "unused", WorkflowParams())
