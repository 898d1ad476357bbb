"""Lineages, sequences, walks, triangles, neighbours and the model on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import ordinal as O
from kinweave.functions.rng import uniform
from kinweave.operators import model as ML
from kinweave.operators import neighbors as N
from kinweave.operators import sketch as K
from kinweave.operators import taxonomy as T
from kinweave.operators import triangles as R
from kinweave.operators import walks as W
from kinweave.operators.graph import adjacency, draw_table
from kinweave.operators.metrics import confusion_matrix, hierarchical_metrics
from kinweave.sources import readers, staging, writers

RANKS = ("Family", "Subfamily", "Genus")


def bounds_by_steps(x, y):
    lower, upper, prev = -1, len(x) - 1, -1
    for k, (a, b) in enumerate(zip(x, y)):
        if a is None or b is None:
            prev = k
        elif a != b:
            upper = prev
            break
        else:
            lower = prev = k
    return lower + 1, upper + 1


def test_bounds_follow_the_stepwise_rule(spark):
    lineages = list(itertools.product([None, "x", "y"], repeat=3))
    meta = spark.createDataFrame([(f"n{i:02d}", *v) for i, v in enumerate(lineages)], "Accession string, Family string, Subfamily string, Genus string")
    pairs = [(i, j) for i, j in itertools.combinations(range(len(lineages)), 2)]
    df = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}") for i, j in pairs], "source string, target string")
    got = {(r.source, r.target): (r.lower, r.upper) for r in T.relationship_bounds(df, meta.fillna("Unknown"), RANKS).collect()}
    assert got == {(f"n{i:02d}", f"n{j:02d}"): bounds_by_steps(lineages[i], lineages[j]) for i, j in pairs}
    kept = T.relationship_bounds(df, meta.fillna(""), RANKS, drop_nr=True)
    assert kept.count() == sum(v != (0, 0) for v in got.values())


def test_reconcile_falls_back_at_nr_only(spark):
    meta = spark.createDataFrame([("p", "nan", "Fam", " Unknown "), ("s", "root", "Other", "Gen")], "Accession string, NR string, Family string, Genus string")
    calls = spark.createDataFrame([("p", "s", 2), ("p", "s", 1), ("x", "s", 2)], "primary string, secondary string, effective_rank int")
    out = T.reconcile_taxonomy(calls, meta, {"NR": 0, "Family": 1, "Genus": 2})
    rows = {(r.primary, r.effective_rank): (r.NR, r.Family, r.Genus) for r in out.collect()}
    assert rows == {("p", 2): ("root", "Fam", ""), ("p", 1): ("root", "Fam", ""), ("x", 2): ("root", "", "")}


def test_long_records_come_in_ordered_pieces(spark):
    meta = spark.createDataFrame([(f"a{i}", "G" if i < 9 else "NA", i) for i in range(10)], "Accession string, Assembly string, row_no bigint")
    seqs = spark.createDataFrame([(f"a{i}.2", chr(97 + i) * 10) for i in range(10)], "id string, seq string")
    rows = T.concat_by_group(meta, seqs, piece_chars=25).orderBy("id", "piece").collect()
    record = "".join(r.seq for r in rows if r.id == "a0.2")
    assert record == "".join(chr(97 + i) * 10 for i in range(9))
    assert all(len(r.seq) <= 35 for r in rows) and [r.seq for r in rows if r.id == "a9.2"] == ["j" * 10]


def test_merge_keeps_first_and_shared_columns(spark):
    s1 = spark.createDataFrame([("x.1", "AA", 0), ("y.1", "CC", 1)], "id string, seq string, row_no int")
    s2 = spark.createDataFrame([("x.2", "TT", 0), ("z.1", "GG", 1)], "id string, seq string, row_no int")
    m1 = spark.createDataFrame([("x", "f1", "only", 0), ("q", "f0", "only", 1)], "Accession string, Family string, Extra string, row_no int")
    m2 = spark.createDataFrame([("x", "f2", 0), ("z", "f3", 1)], "Accession string, Family string, row_no int")
    seqs, meta = T.merge_datasets(s1, m1, s2, m2)
    assert sorted((r.id, r.seq) for r in seqs.collect()) == [("x.1", "AA"), ("y.1", "CC"), ("z.1", "GG")]
    assert sorted((r.Accession, r.Family) for r in meta.collect()) == [("x", "f1"), ("z", "f3")]


def test_fasta_text(spark, tmp_path):
    (tmp_path / "a.faa").write_bytes(b">one first record\r\nAC GT\r\nTT\r\n>two\nGGG\n")
    (tmp_path / "b.faa").write_text(">three x\nCC\n")
    (tmp_path / "c.faa").write_text("")
    rows = {r.id: (r.description, r.seq) for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {"one": ("one first record", "ACGTTT"), "two": ("two", "GGG"), "three": ("three x", "CC")}
    merged = {r.id: r.seq for r in readers.merge_record_folder(spark, str(tmp_path)).collect()}
    assert merged == {"a": "ACGTTT", "b": "CC"}


def test_pieces_are_written_as_one_record(spark):
    path = staging.scratch_path(spark, "fasta")
    pieces = spark.createDataFrame([("r", 1, "CCC"), ("s", 0, "G"), ("r", 0, "AAA")], "id string, piece int, seq string")
    writers.write_fasta(pieces, path)
    assert {r.id: r.seq for r in readers.read_fasta(spark, path).collect()} == {"r": "AAACCC", "s": "G"}


def test_kmers_cross_chunks(spark):
    rng = random.Random(2)
    texts = {"long": "".join(rng.choices("acgté", k=1000)), "short": "ac", "exact": "acgta"}
    got = {}
    for r in K.kmers(spark.createDataFrame(list(texts.items()), "id string, seq string"), 5).collect():
        got.setdefault(r.id, {})[r.pos] = r.kmer
    assert got == {i: {p + 1: t[p:p + 5] for p in range(len(t) - 4)} for i, t in texts.items() if len(t) >= 5}


def edge_table(spark, n=12, seed=3):
    rng = random.Random(seed)
    und = {tuple(sorted(rng.sample(range(n), 2))): round(rng.uniform(0.1, 2), 3) for _ in range(30)}
    return und, spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in und.items()]
                                      + [(f"n{b}", f"n{a}", w) for (a, b), w in und.items()], "source string, target string, weight double")


def test_walks_stay_on_edges(spark):
    und, edges = edge_table(spark)
    names = {(f"n{a}", f"n{b}") for a, b in und} | {(f"n{b}", f"n{a}") for a, b in und}
    walks = W.biased_random_walk(edges, 5, 0.5, 2.0, 3, seed=9).collect()
    assert len(walks) == 3 * len({a for a, _ in names}) and len({r.walk_id for r in walks}) == len(walks)
    assert all(len(r.nodes) == 6 and all(step in names for step in zip(r.nodes, r.nodes[1:])) for r in walks)
    again = W.biased_random_walk(edges, 5, 0.5, 2.0, 3, seed=9).collect()
    assert sorted(walks) == sorted(again)


def test_second_step_has_the_biased_distribution(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("a", "c", 1.0),
                                   ("c", "a", 1.0), ("b", "d", 1.0), ("d", "b", 1.0)], "source string, target string, weight double")
    walks = W.biased_random_walk(edges, 2, 0.5, 2.0, 4000, seed=1)
    rows = walks.where("nodes[0] = 'a' and nodes[1] = 'b'").groupBy(F.col("nodes")[2].alias("to")).count().collect()
    total = sum(r["count"] for r in rows)
    want = {"a": 2 / 3.5, "c": 1 / 3.5, "d": 0.5 / 3.5}
    assert all(abs(r["count"] / total - want[r.to]) < 0.04 for r in rows)


def test_draw_cells_stay_few_per_edge(spark):
    _, edges = edge_table(spark)
    adj = adjacency(edges)
    assert draw_table(adj).count() <= 2 * adj.count()


def test_triangles_and_bounds(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "node string")
    table = {}
    for a, b in itertools.combinations(range(12), 2):
        lo = rng.randint(0, 2)
        table[f"n{a}", f"n{b}"] = (lo, rng.randint(lo, 2))
    bounds = spark.createDataFrame([(a, b, *v) for (a, b), v in table.items()], "source string, target string, lower int, upper int")
    rows = R.sample_triangles(nodes, bounds, 20, 3, seed=4).collect()
    assert len(rows) == 2 * 20 * 3

    def look(a, b):
        return table.get((a, b)) or table[b, a]

    for r in rows:
        assert len({r.q, r.r1, r.r2}) == 3
        assert ((r.lo1, r.up1), (r.lo2, r.up2), (r.lo3, r.up3)) == (look(r.q, r.r1), look(r.q, r.r2), look(r.r1, r.r2))


def test_split_rules(spark):
    few = spark.createDataFrame([(f"n{i}",) for i in range(10)], "node string")
    assert {r.split for r in R.seeded_split(few, 0.9, 0.1, min_nodes=20).collect()} == {"train"}
    more = spark.createDataFrame([(f"n{i}",) for i in range(100)], "node string")
    counts = {r.split: r["count"] for r in R.seeded_split(more).groupBy("split").count().collect()}
    assert counts == {"train": 80, "val": 10, "test": 10}


def test_neighbours_fall_back_to_cosine_and_reuse(spark):
    schema = "source string, target string, weight double"
    hyp = spark.createDataFrame([("q1", "r1", 5.0), ("q1", "r2", 3.0), ("q1", "q2", 9.0)], schema)
    ani = spark.createDataFrame([("q1", "r1", 0.9), ("q1", "r2", 0.8)], schema)
    emb = spark.createDataFrame([("q1", [1.0, 0.0, 1.0, 0.0]), ("q2", [0.0, 1.0, 0.9, 0.1]), ("q3", [0.0, 0.0, 0.0, 0.0]),
                                 ("q4", [0.0, 0.0, 1.0, 0.0]), ("r1", [1.0, 0.0, 1.0, 0.0]), ("r2", [0.0, 1.0, 0.0, 1.0])], "node string, emb array<float>")
    asked = spark.createDataFrame([(f"q{i}",) for i in (1, 2, 3, 4)], "node string")
    allowed = spark.createDataFrame([("r1",), ("r2",)], "node string")
    out = {r.node: (r.r_h, r.r_a, r.sel_h, r.sel_a) for r in N.select_two_neighbors(asked, hyp, ani, allowed, emb, 2).collect()}
    assert out["q1"] == ("r1", "r2", "hyp_adj", "ani_adj")
    assert out["q2"] == ("r1", "r2", "cosine_h", "cosine_a")
    assert out["q3"] == (None, None, "unknown", "unknown")
    assert out["q4"] == ("r1", "r1", "cosine_h", "reuse_h_as_a(cosine_h)")


def test_ordinal_model_is_monotone_and_learns(spark):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        k = rng.randrange(4)
        rows.append((i, [k + rng.gauss(0, 0.2), rng.random()], k, min(3, k + rng.randrange(2))))
    df = spark.createDataFrame(rows, "id int, features array<double>, lower int, upper int")
    out = ML.ordinal_interval_fit(df, 4).transform(df).withColumn("pred", O.argmax(F.col("probs"))).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and min(r.probs) >= 0 for r in out)
    assert sum(r.lower <= r.pred <= r.upper for r in out) > 240


def test_constant_thresholds(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 1), (1, [2.0], 1, 1)], "id int, features array<double>, lower int, upper int")
    probs = ML.ordinal_interval_fit(df, 3).transform(df).select("probs").first().probs
    assert probs == [0.0, 1.0, 0.0]


def test_hierarchical_scores(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 1), (2, 2)]
    cm = confusion_matrix(spark.createDataFrame(pairs, "truth int, pred int"), 3)
    rows = {r.cls: r for r in hierarchical_metrics(cm, 3).collect()}
    assert rows[1].precision == pytest.approx(4 / 5) and rows[1].recall == 1.0 and rows[1].support == 4
    assert rows[0].recall == 0.5 and rows[2].recall == pytest.approx(2 / 3)
    assert rows[0].spearman_rho == pytest.approx(1.0) and rows[0].kendall_tau == pytest.approx(1.0)


def test_stage_is_reused_and_forced(spark):
    path = staging.scratch_path(spark, "stage")
    assert staging.stage_if_absent(spark, path, lambda: spark.range(3)).count() == 3
    assert staging.stage_if_absent(spark, path, lambda: spark.range(9)).count() == 3
    assert staging.stage_if_absent(spark, path, lambda: spark.range(9), force=True).count() == 9


def test_missing_vector_predicts_nothing(spark):
    rows = spark.createDataFrame([(0, s, "a", "b", 1, 1, False, [0.0, math.pi]) for s in (1, 2, 3)],
                                 "id int, side int, a string, b string, lower int, upper int, known boolean, features array<double>")
    first = ML.OrdinalModel(3, [1.0, 0.5])
    model = ML.TriangleModel(first, ML.OrdinalModel(3, [1.0, 1.0]), 0.12, 1)
    assert ML.predict_rank(model, rows).collect() == [(0, 0, 0.0, 0, 0.0)]


def test_draws_do_not_repeat_beyond_the_modulus(spark):
    ids = [5 + n * 2147483647 for n in range(200)] + [2 ** 61 + n for n in range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select(uniform("id", "0", 7).alias("u")).collect()
    values = [r.u for r in rows]
    assert len(set(values)) == len(ids) and all(0 <= u < 1 for u in values) and 0.4 < sum(values) / len(values) < 0.6


def test_light_and_heavy_weights_can_be_drawn(spark):
    edges = spark.createDataFrame([("a", "b", 1e-12), ("a", "c", 3e-12), ("h", "x", 1e4), ("h", "y", 4e9), ("h", "z", 1e-12)],
                                  "source string, target string, weight double")
    mass = {(r.node, r.neighbor): (r.mass, r.total) for r in adjacency(edges).collect()}
    assert mass["a", "b"] == (333333333, 1333333333) and mass["a", "c"][0] == 1000000000
    assert mass["h", "x"][0] == 2500 and mass["h", "z"][0] == 1


def test_two_nodes_form_no_triangle(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "node string")
    bounds = spark.createDataFrame([("a", "b", 1, 1)], "source string, target string, lower int, upper int")
    with pytest.raises(ValueError):
        R.sample_triangles(nodes, bounds, 2, 3)


def test_first_row_of_an_accession_counts(spark):
    meta = spark.createDataFrame([("x", "F2", "G2", 2), ("x", "F1", "G1", 1), ("y", "F1", "G3", 3)], "Accession string, Family string, Genus string, row_no int")
    calls = spark.createDataFrame([("x", "y", 2)], "primary string, secondary string, effective_rank int")
    rows = T.reconcile_taxonomy(calls, meta, {"NR": 0, "Family": 1, "Genus": 2}).collect()
    assert [(r.Family, r.Genus) for r in rows] == [("F1", "G1")]
    pairs = spark.createDataFrame([("x", "y")], "source string, target string")
    assert [(r.lower, r.upper) for r in T.relationship_bounds(pairs, meta, ["Family", "Genus"]).collect()] == [(1, 1)]
