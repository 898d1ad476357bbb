"""Queries over ordinal scores, triangles, the model and the whole workflow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.graphs import SYM_SQL
from kinweave.catalog.taxonomy import LINEAGE, PAIR_SQL, bounds_sql
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.functions import ordinal as O
from kinweave.functions.columns import pair_high, pair_low, strip_version
from kinweave.functions.rng import hash_order_sql, uniform_sql
from kinweave.operators import graph as G
from kinweave.operators import model as ML
from kinweave.operators import triangles as T
from kinweave.operators.taxonomy import relationship_bounds
from kinweave.plans.classify import classify_new, evaluate_database
from kinweave.plans.params import WorkflowParams
from kinweave.sources import staging
from kinweave.sources.staging import materialize

K = 4
DIM = 64  # numbers of a vector of the test tables

PARTS = 16  # a vector of 64 numbers gives 16 rows of K logits; their vec_id is vec_id * PARTS + part

TRI_SQL = f"""em as (select vec_id, label, part, list_transform(embedding[{K} * part + 1:{K} * part + {K}], lambda x: x::double * 10) as l
    from embeddings, range({PARTS}) p(part)),
    t as (select a.vec_id * {PARTS} + a.part as vec_id, a.l as la, b.l as lh, c.l as lr,
    a.label % 4 as lo1, least(3, a.label % 4 + a.vec_id % 3) as up1, b.label % 4 as lo2, least(3, b.label % 4 + b.vec_id % 3) as up2,
    c.label % 4 as lo3, least(3, c.label % 4 + c.vec_id % 3) as up3
    from em a join em b on b.vec_id = a.vec_id + 1 and b.part = a.part join em c on c.vec_id = a.vec_id + 2 and c.part = a.part)"""


def logit_triangles(spark, d):
    parts = table(spark, d, "embeddings").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    e = parts.select(
        "vec_id", "part", F.transform(F.slice("embedding", F.col("part") * K + 1, F.lit(K)), lambda x: x.cast("double") * 10).alias("l"),
        (F.col("label") % 4).alias("lo"), F.least(F.lit(3), F.col("label") % 4 + F.col("vec_id") % 3).alias("up"))

    def side(n, name, shift):
        return e.select(((F.col("vec_id") - shift) * PARTS + F.col("part")).alias("vec_id"), F.col("l").alias(name),
                        F.col("lo").alias(f"lo{n}"), F.col("up").alias(f"up{n}"))

    return side(1, "la", 0).join(side(2, "lh", 1), "vec_id").join(side(3, "lr", 2), "vec_id")


def _s(a: str, k: int) -> str:
    return f"(1.0 / (1.0 + exp(-{a}[{k}])))"


def _p(a: str, k: int) -> str:
    return f"({_s(a, k)} - {_s(a, k + 1)})" if k < K else _s(a, k)


def _soft(a: str, k: int) -> str:
    return f"(exp({a}[{k}]) / ({' + '.join(f'exp({a}[{j}])' for j in range(1, K + 1))}))"


def _rank(a: str, f=_p) -> str:
    return "(" + " + ".join(f"{k - 1} * {f(a, k)}" for k in range(1, K + 1)) + ")"


@query("adjacent_probs", oracle(f"""with {TRI_SQL}, p as (select vec_id, [{', '.join(_p('la', k) for k in range(1, K + 1))}] as p from t)
    select vec_id, generate_subscripts(p, 1) - 1 as cls, round(unnest(p), 6) as prob from p"""))
def _(spark, d):
    rows = logit_triangles(spark, d).select("vec_id", F.posexplode(O.adjacent_probs(F.col("la"))).alias("cls", "prob"))
    return rows.select("vec_id", F.col("cls").cast("bigint").alias("cls"), F.round("prob", 6).alias("prob"))


@query("expected_rank", oracle(f"""with {TRI_SQL} select vec_id, round({_rank('la')}, 6) as cumulative,
    round({_rank('la', _soft)}, 6) as softmax from t"""))
def _(spark, d):
    return logit_triangles(spark, d).select(
        "vec_id", F.round(O.expected_rank(F.col("la")), 6).alias("cumulative"),
        F.round(O.expected_rank_softmax(F.col("la")), 6).alias("softmax"))


def _bce(a: str, n: int) -> str:
    terms = [f"case when {k - 1} <= lo{n} then -ln({_s(a, k)}) when {k - 1} > up{n} then -ln(1 - {_s(a, k)}) else 0 end" for k in range(1, K + 1)]
    counts = [f"case when {k - 1} <= lo{n} or {k - 1} > up{n} then 1 else 0 end" for k in range(1, K + 1)]
    return f"sum({' + '.join(terms)}) / greatest(sum({' + '.join(counts)}), 1)"


@query("interval_bce", oracle(f"""with {TRI_SQL} select vec_id % 10 as batch, round({_bce('la', 1)}, 6) as loss from t group by 1"""))
def _(spark, d):
    return logit_triangles(spark, d).groupBy((F.col("vec_id") % 10).alias("batch")).agg(
        F.round(O.interval_bce(F.col("la"), F.col("lo1"), F.col("up1")), 6).alias("loss"))


def _ce(a: str, n: int) -> str:
    inside = " + ".join(f"case when {k - 1} between lo{n} and up{n} then {_soft(a, k)} else 0 end" for k in range(1, K + 1))
    return f"-ln(greatest({inside}, 1e-12))"


@query("interval_ce", oracle(f"with {TRI_SQL} select vec_id, round({_ce('la', 1)}, 6) as loss from t"))
def _(spark, d):
    return logit_triangles(spark, d).select("vec_id", F.round(
        O.interval_ce(F.col("la"), F.col("lo1"), F.col("up1")), 6).alias("loss"))


def _rooted(base: str, x: str, y: str) -> str:
    return "((" + " + ".join(
        f"power({_s(x, k)} - {_s(y, k)}, 2) + power(greatest({_s(base, k)} - {_s(x, k)}, 0), 2) + power(greatest({_s(base, k)} - {_s(y, k)}, 0), 2)"
        for k in range(1, K + 1)) + f") / {K})"


_ULTRA = f"least({_rooted('lr', 'la', 'lh')}, {_rooted('lh', 'la', 'lr')}, {_rooted('la', 'lh', 'lr')})"


@query("ultrametric_violation", oracle(f"with {TRI_SQL} select vec_id, round({_ULTRA}, 6) as loss from t"))
def _(spark, d):
    return logit_triangles(spark, d).select("vec_id", F.round(
        O.ultrametric_violation(F.col("la"), F.col("lh"), F.col("lr")), 6).alias("loss"))


def _hinge(p: str, lo: str, up: str) -> str:
    return f"(power(greatest({lo} - {p}, 0), 2) + power(greatest({p} - {up}, 0), 2))"


_R1, _R2 = _rank("la", _soft), _rank("lh", _soft)
_DUAL = f"({_hinge(_R1, f'least({_R2}, lo3)', f'least({_R2}, up3)')} + {_hinge(_R2, f'least({_R1}, lo3)', f'least({_R1}, up3)')})"


@query("rank_hinge_consistency", oracle(f"with {TRI_SQL} select vec_id, round({_DUAL}, 6) as loss from t"))
def _(spark, d):
    return logit_triangles(spark, d).select("vec_id", F.round(O.rank_hinge_consistency(
        O.expected_rank_softmax(F.col("la")), O.expected_rank_softmax(F.col("lh")), F.col("lo3"), F.col("up3")), 6).alias("loss"))


def _sides():
    return [(F.col(n), F.col(f"lo{i}"), F.col(f"up{i}")) for i, n in enumerate(("la", "lh", "lr"), 1)]


@query("combined_loss", oracle(f"""with {TRI_SQL} select vec_id % 10 as batch,
    round(1.0 * ({_bce('la', 1)} + {_bce('lh', 2)} + {_bce('lr', 3)}) + 0.5 * avg({_ULTRA}), 6) as loss,
    round(1.0 * (avg({_ce('la', 1)}) + avg({_ce('lh', 2)})) + 0.5 * avg({_DUAL}), 6) as legacy from t group by 1"""))
def _(spark, d):
    return logit_triangles(spark, d).groupBy((F.col("vec_id") % 10).alias("batch")).agg(
        F.round(O.combined_loss(_sides(), 1.0, 0.5), 6).alias("loss"),
        F.round(O.legacy_loss(_sides(), 1.0, 0.5), 6).alias("legacy"))


# --- triangles -----------------------------------------------------------------------------

PER_CLASS, SEED = 300, 42


def _u(step: str) -> str:
    return uniform_sql("id", step, SEED)


EDGE_BOUNDS_SQL = f"{PAIR_SQL}, {bounds_sql('pr')}, nd as (select Accession as node from v_taxa)"
TRIANGLE_SQL = f"""{EDGE_BOUNDS_SQL},
    bc as (select source, target, 'U' as dir, upper as cls from bounds union all select source, target, 'L', lower from bounds),
    bk as materialized (select *, row_number() over (partition by dir, cls order by {hash_order_sql('bucket', 'source', 'target')}, source, target) - 1 as ordinal from bc),
    sz as (select dir, cls, count(*) as n from bc group by 1, 2),
    us as (select cls from sz group by cls having count(*) = 2),
    dr as (select id, case when id % 2 = 0 then 'U' else 'L' end as dir, cast(floor(id / {2 * PER_CLASS}) as int) as cls from range({2 * K * PER_CLASS}) r(id)),
    pl as (select id, b.source, b.target from dr join sz using (dir, cls) join bk b on b.dir = dr.dir and b.cls = dr.cls
      and b.ordinal = cast(floor({_u('0')} * n) as bigint) where dr.cls in (select cls from us)),
    pm as materialized (select id, case when {_u('1')} < 0.5 then target else source end as q, case when {_u('1')} < 0.5 then source else target end as r1,
      cast(floor({_u('2')} * {2 * K}) as int) as key from pl),
    di as (select source as q, target as other, dir, cls from bc union all select target, source, dir, cls from bc),
    nb as materialized (select *, row_number() over (partition by q, dir, cls order by {hash_order_sql('neighbor', 'other')}, other) - 1 as ordinal,
      count(*) over (partition by q, dir, cls) as n from di),
    tr as (select id, pm.q, pm.r1, t, nb.other from pm, range(4) s(t), nb where nb.q = pm.q and nb.dir = case when key < {K} then 'U' else 'L' end
      and nb.cls = key % {K} and nb.ordinal = cast(floor({_u('3 + t')} * nb.n) as bigint)),
    fo as (select id, min_by(other, t) as near from tr where other <> q and other <> r1 group by id),
    nn as materialized (select node, row_number() over (order by {hash_order_sql('node', 'node')}, node) - 1 as ordinal from nd),
    ms as (select id, least(a.ordinal, b.ordinal) as lo, greatest(a.ordinal, b.ordinal) as hi,
      cast(floor({_u('7')} * ((select count(*) from nd) - 2)) as bigint) as x from pm join nn a on a.node = q join nn b on b.node = r1
      where id not in (select id from fo)),
    m2 as (select id, hi, x + (x >= lo)::int as x from ms),
    fa as (select id, nn.node as near from m2 join nn on nn.ordinal = x + (x >= hi)::int),
    tg as (select pm.id, q, r1, near as r2 from pm join (select * from fo union all select * from fa) f on f.id = pm.id),
    tri as materialized (select id, q, r1, r2, coalesce(a.lower, 0) as lo1, coalesce(a.upper, 0) as up1, coalesce(b.lower, 0) as lo2,
      coalesce(b.upper, 0) as up2, coalesce(c.lower, 0) as lo3, coalesce(c.upper, 0) as up3 from tg
      left join bounds a on a.source = least(q, r1) and a.target = greatest(q, r1)
      left join bounds b on b.source = least(q, r2) and b.target = greatest(q, r2)
      left join bounds c on c.source = least(r1, r2) and c.target = greatest(r1, r2))"""


def edge_triangles(spark, d):
    edges, taxa = spark_view(spark, d, "v_edges"), spark_view(spark, d, "v_taxa")
    pairs = edges.where("source <> target").select(
        pair_low("source", "target").alias("source"), pair_high("source", "target").alias("target")).distinct()
    bounds = relationship_bounds(pairs, taxa, LINEAGE)
    return T.sample_triangles(taxa.select(F.col("Accession").alias("node")), bounds, PER_CLASS, K, SEED)


@query("sample_triangles", oracle(f"with {TRIANGLE_SQL} select * from tri", "v_edges", "v_taxa"))
def _(spark, d):
    return edge_triangles(spark, d)


# The gene-sharing weight of the fixture is the reversed identity weight.
WEIGHT_SQL = f"""{TRIANGLE_SQL}, und as (select least(source, target) as u, greatest(source, target) as v, max(weight) as ani,
    max(1 - weight) as hyp from v_edges where source <> target group by 1, 2)"""


def two_graphs(spark, d):
    edges = spark_view(spark, d, "v_edges")
    return G.undirected_max(edges), G.undirected_max(edges.withColumn("weight", 1 - F.col("weight")))


@query("edge_weight_lookup", oracle(f"""with {WEIGHT_SQL} select id, round(coalesce(a.ani, 0), 8) as ani1, round(coalesce(a.hyp, 0), 8) as hyp1,
    round(coalesce(b.ani, 0), 8) as ani2, round(coalesce(b.hyp, 0), 8) as hyp2, round(coalesce(c.ani, 0), 8) as ani3, round(coalesce(c.hyp, 0), 8) as hyp3
    from tri left join und a on a.u = least(q, r1) and a.v = greatest(q, r1) left join und b on b.u = least(q, r2) and b.v = greatest(q, r2)
    left join und c on c.u = least(r1, r2) and c.v = greatest(r1, r2)""", "v_edges", "v_taxa"))
def _(spark, d):
    out = T.edge_weight_lookup(edge_triangles(spark, d), *two_graphs(spark, d))
    return out.select("id", *[F.round(f"{g}{n}", 8).alias(f"{g}{n}") for n in (1, 2, 3) for g in ("ani", "hyp")])


@query("triangle_features", oracle(f"""with {WEIGHT_SQL}, sd as (select id, 1 as side, q as a, r1 as b, lo1 as lower, up1 as upper from tri
    union all select id, 2, q, r2, lo2, up2 from tri union all select id, 3, r1, r2, lo3, up3 from tri),
    em as (select concat('C', vec_id, '.1') as node, list_transform(embedding, lambda x: x::double) as e from embeddings),
    z as (select list_transform(range({DIM}), lambda x: 0.0::double) as z),
    fs as (select id, side, lower, upper, x.e is not null and y.e is not null as known, coalesce(x.e, z) as xa, coalesce(y.e, z) as xb,
      coalesce(ani, 0.0) as ani, coalesce(hyp, 0.0) as hyp from sd cross join z left join em x on x.node = a left join em y on y.node = b
      left join und on u = least(a, b) and v = greatest(a, b))
    select id, side, cast(lower as int) as lower, cast(upper as int) as upper, known, round(list_sum(list_transform(list_zip(xa, xb), lambda p: p[1] + 2 * p[2])), 5) as ends,
    round(list_sum(list_transform(list_zip(xa, xb), lambda p: abs(p[1] - p[2]))), 5) as gap, round(ani, 8) as ani, round(hyp, 8) as hyp, cast({3 * DIM + 2} as int) as width from fs""",
    "v_edges", "v_taxa"))
def _(spark, d):
    emb = table(spark, d, "embeddings").select(F.concat(F.lit("C"), "vec_id", F.lit(".1")).alias("node"),
                                               F.col("embedding").alias("emb"))
    rows = T.triangle_features(edge_triangles(spark, d), emb, *two_graphs(spark, d), DIM)
    f = F.col("features")
    ends = O.total(F.zip_with(F.slice(f, 1, DIM), F.slice(f, DIM + 1, DIM), lambda x, y: x + 2 * y))
    return rows.select("id", "side", "lower", "upper", "known", F.round(ends, 5).alias("ends"),
                       F.round(O.total(F.transform(F.slice(f, 2 * DIM + 1, DIM), F.abs)), 5).alias("gap"),
                       F.round(f[3 * DIM], 8).alias("ani"), F.round(f[3 * DIM + 1], 8).alias("hyp"), F.size(f).alias("width"))


@query("seeded_split", oracle(f"""with n as (select node, row_number() over (order by {hash_order_sql('split', 'node')}, node) - 1 as o,
    count(*) over () as n from (select source as node from v_edges union select target from v_edges))
    select node, case when o < floor(0.8 * n) then 'train' when o < floor(0.9 * n) then 'val' else 'test' end as split from n""", "v_edges"))
def _(spark, d):
    return T.seeded_split(G.node_set(spark_view(spark, d, "v_edges")), 0.8, 0.1)


# --- model and workflow --------------------------------------------------------------------

def label_rows(spark, d):
    """Rows with features and censored ordinal labels from the vectors."""
    return table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("label") % K).cast("int").alias("lower"),
        F.least(F.lit(K - 1), F.col("label") % K + F.col("vec_id") % 2).cast("int").alias("upper"))


@query("threshold_counts", oracle(f"""with r as (select label % {K} as lower, least({K - 1}, label % {K} + vec_id % 2) as upper from embeddings)
    select cast(k as int) as k, (lower >= k)::int as label, count(*) as n from r, range(1, {K}) t(k) where lower >= k or upper < k group by 1, 2"""))
def _(spark, d):
    return ML.threshold_counts(label_rows(spark, d), K)


_M = [f"least({', '.join(['1.0'] + [_s('la', j) for j in range(2, k + 1)])})" for k in range(1, K + 1)]
_FIXED = ", ".join(f"{_M[k]} - {_M[k + 1] if k < K - 1 else '0.0'}" for k in range(K))


@query("monotone_probs", oracle(f"""with {TRI_SQL}, b as (select vec_id, [{_FIXED}] as p from t)
    select vec_id, generate_subscripts(p, 1) - 1 as cls, round(unnest(p), 6) as prob from b"""))
def _(spark, d):
    rows = logit_triangles(spark, d)
    at_least = F.concat(F.array(F.lit(1.0)), F.slice(O.at_least_probs(F.col("la")), 2, K))
    each = rows.withColumn("s", ML.running_min(at_least)).select("vec_id", F.posexplode(O.steps(F.col("s"))).alias("cls", "prob"))
    return each.select("vec_id", F.col("cls").cast("bigint").alias("cls"), F.round("prob", 6).alias("prob"))


# given coefficients: weights and cuts of every threshold by a rule
WEIGHTS = [[round(0.1 * ((3 * k + j) % 5 - 2), 1) for j in range(DIM)] for k in range(1, K)]
CUTS = [-0.5, 0.25, 0.75]
_Z = [f"(list_dot_product(x, {WEIGHTS[k - 1]}::double[]) - {CUTS[k - 1]})" for k in range(1, K)]


def _going_on() -> str:
    """Chance to go on beyond the interval: the product over the thresholds behind its lower end up to the one behind its upper end."""
    return " * ".join(f"case when {k} > lower and {k} <= upper + 1 then q{k} else 1.0 end" for k in range(1, K))


def _slope(k: int) -> str:
    return (f"case when {k} <= lower then q{k} - 1 when {k} <= upper + 1 and upper < {K - 1} then r * (1 - q{k}) / (1 - r) else 0.0 end")


@query("ordinal_gradient", oracle(f"""with e as (select list_transform(embedding, lambda v: v::double) as x, label % {K} as lower, least({K - 1}, label % {K} + vec_id % 2) as upper from embeddings),
    q as (select *, {', '.join(f'1.0 / (1.0 + exp(-{_Z[k - 1]})) as q{k}' for k in range(1, K))} from e), r as (select *, {_going_on()} as r from q),
    s as (select *, {' + '.join(f'case when {k} <= lower then -ln(q{k}) else 0.0 end' for k in range(1, K))} + case when upper < {K - 1} then -ln(1 - r) else 0.0 end as loss,
      {', '.join(f'{_slope(k)} as s{k}' for k in range(1, K))} from r),
    g as (select 0 as pos, sum(loss) as value from s
      {' '.join(f"union all select {(k - 1) * DIM} + j, sum(s{k} * x[j]) from s, range(1, {DIM + 1}) t(j) group by j union all select {(K - 1) * DIM + k}, -sum(s{k}) from s" for k in range(1, K))})
    select cast(pos as int) as pos, round(value, 6) as value from g"""))
def _(spark, d):
    sums = ML.loss_and_gradient(label_rows(spark, d), [(np.array(WEIGHTS), np.array(CUTS))], [None] * (K - 1))
    return sums.select("pos", F.round("value", 6).alias("value"))


@query("ordinal_interval_fit")
def _(spark, d):
    rows = label_rows(spark, d)
    model = ML.ordinal_interval_fit(rows, K)
    return model.transform(rows).select("vec_id", "lower", "upper", O.argmax(F.col("probs")).alias("pred"),
                                        F.posexplode("probs").alias("cls", "prob"))


def side_rows(spark, d):
    emb = table(spark, d, "embeddings").select(F.concat(F.lit("C"), "vec_id", F.lit(".1")).alias("node"),
                                               F.col("embedding").alias("emb"))
    return materialize(T.triangle_features(edge_triangles(spark, d), emb, *two_graphs(spark, d), DIM), "rows")


@query("triangle_refine")
def _(spark, d):
    rows = side_rows(spark, d)
    model = ML.triangle_refine(rows, ML.ordinal_interval_fit(rows, K))
    return model.transform(rows).select("id", "side", "lower", "upper", F.posexplode("probs").alias("cls", "prob"))


@query("predict_rank")
def _(spark, d):
    rows = side_rows(spark, d)
    return ML.predict_rank(ML.triangle_refine(rows, ML.ordinal_interval_fit(rows, K)), rows)


_BLEND = ", ".join(f"0.12 * {_p('la', k)} + 0.88 * {_p('lh', k)}" for k in range(1, K + 1))


@query("blend_probs", oracle(f"""with {TRI_SQL}, b as (select vec_id, [{_BLEND}] as p from t)
    select vec_id, generate_subscripts(p, 1) - 1 as cls, round(unnest(p), 6) as prob from b"""))
def _(spark, d):
    mixed = O.blend(O.adjacent_probs(F.col("la")), O.adjacent_probs(F.col("lh")), 0.12)
    rows = logit_triangles(spark, d).select("vec_id", F.posexplode(mixed).alias("cls", "prob"))
    return rows.select("vec_id", F.col("cls").cast("bigint").alias("cls"), F.round("prob", 6).alias("prob"))


# the published settings; only the labelled rows are bounded
BOUNDED = WorkflowParams(triangles_train=400, triangles_eval=100)


def _workflow_inputs(spark, d):
    return (spark_view(spark, d, "v_items"), spark_view(spark, d, "v_edges"), spark_view(spark, d, "v_taxa"))


@query("classify_queries")
def _(spark, d):
    pa, edges, taxa = _workflow_inputs(spark, d)
    asked = taxa.where("Family = 'Unknown'").select(F.col("Accession").alias("query"))
    own = [asked.select(F.col("query").alias(end)) for end in ("source", "target")]
    bare = asked.select(strip_version("query").alias("query"))
    among = edges.join(own[0], "source", "left_semi").join(own[1], "target", "left_semi")
    known = edges.join(own[0], "source", "left_anti").join(own[1], "target", "left_anti")
    between = (edges.join(own[0], "source", "left_semi").join(own[1], "target", "left_anti")
               .unionByName(edges.join(own[0], "source", "left_anti").join(own[1], "target", "left_semi")))
    return classify_new(pa.join(bare, "query", "left_anti"), pa.join(bare, "query", "left_semi"), [known, among, between],
                        taxa, asked, staging.scratch_path(spark, "results"), BOUNDED)


@query("evaluate_database")
def _(spark, d):
    return evaluate_database(*_workflow_inputs(spark, d), BOUNDED)
