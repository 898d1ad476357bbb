"""What pair counts and k-mer sets shuffle and write, and their results against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from kinweave.operators import sketch, skew

RECORDS = "id string, seq string"


def texts():
    rng = random.Random(5)
    made = [(f"s{n}", "".join(rng.choices("acgté", k=length))) for n, length in enumerate((3, 4, 300, 1000, 2500))]
    return [*made, ("s2", made[3][1]), ("none", None), (None, "acgtacgt")]


def expected_sets(rows, k):
    sets = {}
    for i, t in rows:
        for p in range(len(t or "") - k + 1):
            sets.setdefault(i, set()).add(t[p:p + k])
    return sets


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pairs_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "MEMBERS", 4)
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(30)}", f"s{rng.randrange(40):02d}", 7) for _ in range(600)]
    rows += [("hot", f"s{n:02d}", 7) for n in range(40)] + [(None, "s01", 7), ("t1", None, 7)]
    out = skew.pair_counts(spark.createDataFrame(rows, "target string, query string, size int"), "target", "query", ["size"])
    groups, want = {}, Counter()
    for t, s, _ in rows:
        if t and s:
            groups.setdefault(t, []).append(s)
    for members in groups.values():
        want.update((min(p), max(p)) for p in itertools.combinations(members, 2) if p[0] != p[1])
    assert {(r.i, r.j): r.c for r in out.collect()} == want
    assert {(r.size_i, r.size_j) for r in out.collect()} == {(7, 7)}
    assert not re.search(r"hashpartitioning\([^)]*\bj#", plan(out))


def test_kmer_sketch_shuffles_smallest_hashes_only(spark, monkeypatch):
    monkeypatch.setattr(sketch, "PIECE", 128)
    out = sketch.kmer_sketch(spark.createDataFrame(texts(), RECORDS), 4, 8)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.rank):
        got.setdefault(r.id, []).append(r.hash)
    assert got == {i: sorted(hashlib.md5(x.encode()).hexdigest() for x in s)[:8] for i, s in expected_sets(texts(), 4).items()}
    assert not re.search(r"hashpartitioning\([^)]*\bhash#", plan(out))


def test_kmer_sets_of_short_and_long_ids(spark, monkeypatch):
    monkeypatch.setattr(sketch, "PIECE", 128)
    for limit in (1 << 20, 900):
        monkeypatch.setattr(sketch, "LONG", limit)
        got = [(r.id, r.hash) for r in sketch.kmer_sets(spark.createDataFrame(texts(), RECORDS), 4).collect()]
        assert sorted(got, key=str) == sorted(((i, x) for i, s in expected_sets(texts(), 4).items() for x in s), key=str)


def test_sketch_ani_writes_met_kmers_only(spark, monkeypatch):
    rng = random.Random(6)
    refs = [(f"r{n}", "".join(rng.choices("acgt", k=2000))) for n in range(5)]
    written, write = [], sketch.materialize

    def counted(df, label):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(sketch, "materialize", counted)
    sets = [sketch.kmer_sets(spark.createDataFrame(rows, RECORDS)) for rows in ([("q", refs[0][1][:100])], refs)]
    found = {(r.Query_name, r.Ref_name): r.Align_fraction_query for r in sketch.sketch_ani(*sets).collect()}
    assert found[("q", "r0")] == 100.0
    assert max(written) < 500


def counted_by_hand(rows):
    groups, want = {}, Counter()
    for t, s, size in rows:
        if t is not None and s is not None:
            groups.setdefault(t, []).append((s, size))
    for members in groups.values():
        want.update((*min(p, q), *max(p, q)) for p, q in itertools.combinations(members, 2) if p[0] != q[0])
    return want


@pytest.mark.parametrize("cells, block_ids, rare", [(1 << 21, 64, 0), (500, 16, 400), (40, 400, 3000)])
def test_pairs_of_large_groups_are_counted_by_blocks_of_ids(spark, monkeypatch, cells, block_ids, rare):
    monkeypatch.setattr(skew, "TASK_PAIRS", 64)
    monkeypatch.setattr(skew, "BLOCK_IDS", block_ids)
    monkeypatch.setattr(skew, "CELLS", cells)
    rng = random.Random(4)
    rows = [(f"t{t}", f"s{s:03d}é", s % 3) for t in range(12) for s in range(120) if rng.random() < 0.7]
    rows += [(f"u{rng.randrange(900)}", f"s{rng.randrange(120):03d}é", None) for _ in range(rare)]
    rows += [*rows[:40], ("t1", "s001é", 9), (None, "s001é", 1), ("t1", None, 1)]
    out = skew.pair_counts(spark.createDataFrame(rows, "target string, query string, size int"), "target", "query", ["size"])
    got = {(r.i, r.size_i, r.j, r.size_j): r.c for r in out.collect()}
    plain = Counter()
    for (a, x, b, y), n in counted_by_hand([(t, s, -1 if z is None else z) for t, s, z in rows]).items():
        plain[(a, None if x == -1 else x, b, None if y == -1 else y)] += n
    assert got == plain
    # groups of 80 ids sent their members to every bucket; now an id is sent once per block
    assert "FlatMapGroupsInArrow" in plan(out)
