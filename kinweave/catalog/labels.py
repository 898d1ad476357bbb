"""Queries over predicted labels: scores, reconciliation, the result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.graphs import UND_SQL
from kinweave.catalog.taxonomy import LINEAGE
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.operators import graph as G
from kinweave.operators import metrics as M
from kinweave.operators import neighbors as N
from kinweave.operators import taxonomy as T
from kinweave.plans.references import score_predictions

PROFILE = {"NR": 0, "Family": 1, "Subfamily": 2, "Genus": 3}


def _label(c: str) -> str:
    return (f"case when trim(coalesce({c}, '')) in ('', 'Unknown', 'unclassified', 'Unclassified') "
            f"then 'Unclassified' else trim({c}) end")


MERGED_SQL = "merged as (select split_part(p.Accession, '.', 1) as Accession, " + ", ".join(
    f"{_label('p.' + r)} as {r}_pred, {_label('t.' + r)} as {r}_ans" for r in LINEAGE) + """
    from v_pred p join v_taxa t on split_part(p.Accession, '.', 1) = split_part(t.Accession, '.', 1))"""


def merged(spark, d):
    return M.pred_vs_truth(spark_view(spark, d, "v_pred"), spark_view(spark, d, "v_taxa"))


@query("pred_vs_truth", oracle(f"with {MERGED_SQL} select * from merged", "v_pred", "v_taxa"))
def _(spark, d):
    return merged(spark, d)


PRF_SQL = MERGED_SQL + ", long as (" + " union all ".join(
    f"select '{r}' as rank, {r}_ans as truth, {r}_pred as pred from merged" for r in LINEAGE) + """),
    ok as (select * from long where truth <> 'Unclassified' and pred <> 'Unclassified'),
    lab as (select rank, truth as label from ok union select rank, pred from ok),
    cnt as (select rank, label, (select count(*) from ok where ok.rank = lab.rank and truth = label) as support,
    (select count(*) from ok where ok.rank = lab.rank and pred = label) as predicted,
    (select count(*) from ok where ok.rank = lab.rank and pred = label and truth = label) as tp from lab),
    pr as (select rank, label, support, coalesce(tp / nullif(predicted, 0), 0.0) as p, coalesce(tp / nullif(support, 0), 0.0) as r from cnt),
    prf as (select rank, label, p as precision, r as recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0) as f1, support from pr)"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("label_prf", oracle(f"""with {PRF_SQL} select rank, label, round(precision, 6) as precision, round(recall, 6) as recall,
    round(f1, 6) as f1, support from prf""", "v_pred", "v_taxa"))
def _(spark, d):
    return rounded(M.label_prf(merged(spark, d)), "precision", "recall", "f1")


@query("sort_by_support_topn", oracle(f"""with {PRF_SQL} select rank, label, support, position from (select *, row_number() over (
    partition by rank order by support desc, label) as position from prf) where position <= 1000""", "v_pred", "v_taxa"))
def _(spark, d):
    out = M.sort_by_support_topn(M.label_prf(merged(spark, d)), 1000)
    return out.select("rank", "label", "support", F.col("position").cast("bigint").alias("position"))


@query("score_predictions", oracle(f"""with {PRF_SQL} select rank, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
    round(avg(f1), 6) as f1 from prf group by rank""", "v_pred", "v_taxa"))
def _(spark, d):
    out = score_predictions(spark_view(spark, d, "v_pred"), spark_view(spark, d, "v_taxa"))
    return rounded(out, "precision", "recall", "f1")


@query("confusion_matrix", oracle("""with g as (select cast(t as int) as truth, cast(p as int) as pred from range(4) a(t), range(4) b(p))
    select truth, g.pred, count(v.source) as n from g left join v_bounds v on v.lower = g.truth and v.pred = g.pred group by 1, 2""", "v_bounds"))
def _(spark, d):
    return M.confusion_matrix(spark_view(spark, d, "v_bounds").withColumnRenamed("lower", "truth"), 4)


@query("hierarchical_metrics", oracle("""with c as (select cast(c as int) as cls from range(4) t(c)),
    s as (select cls, count(*) filter (where case when cls = 0 then lower = 0 and pred = 0 else lower >= cls and pred >= cls end) as tp,
    count(*) filter (where case when cls = 0 then pred = 0 else pred >= cls end) as pr,
    count(*) filter (where case when cls = 0 then lower = 0 else lower >= cls end) as support from c, v_bounds group by cls),
    q as (select *, coalesce(tp / nullif(pr, 0), 0.0) as p, coalesce(tp / nullif(support, 0), 0.0) as r from s),
    m as (select lower as t, avg(pred) as mean from v_bounds group by lower),
    k as (select t, mean, rank() over (order by t) as rt, rank() over (order by mean) + (count(*) over (partition by mean) - 1) / 2.0 as rm from m),
    x as (select sum(sign(b.mean - a.mean)) as sm, count(*) as n0, count(*) filter (where a.mean <> b.mean) as n1 from m a join m b on a.t < b.t)
    select cls, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) as f1, support,
    (select round(corr(rt, rm), 6) from k) as spearman_rho, (select round(sm / sqrt(n0 * n1), 6) from x) as kendall_tau from q""", "v_bounds"))
def _(spark, d):
    cm = M.confusion_matrix(spark_view(spark, d, "v_bounds").withColumnRenamed("lower", "truth"), 4)
    return rounded(M.hierarchical_metrics(cm, 4), "precision", "recall", "f1", "spearman_rho", "kendall_tau")


@query("interval_hit_point_accuracy", oracle("""select round(avg((pred between lower and upper)::int), 6) as hit_rate,
    round(avg((pred = lower)::int) filter (where lower = upper), 6) as point_accuracy,
    count(*) filter (where lower = upper) as n_points, count(*) as n from v_bounds""", "v_bounds"))
def _(spark, d):
    return rounded(M.interval_hit_point_accuracy(spark_view(spark, d, "v_bounds")), "hit_rate", "point_accuracy")


# --- choice and reconciliation -------------------------------------------------------------

CALLS_SQL = """calls as (select concat('C', c_custkey, '.1') as query, concat('C', (c_custkey * 3 + 1) % (select count(*) from customer), '.1') as r_h,
    concat('C', (c_custkey * 5 + 2) % (select count(*) from customer), '.1') as r_a, cast(c_custkey % 4 as int) as rank_h,
    cast((c_custkey * 7 + 1) % 4 as int) as rank_a, 0.5 + (c_custkey % 50) / 100.0 as prob_h, 0.5 + (c_custkey % 37) / 100.0 as prob_a from customer),
    chosen as (select *, case when rank_h >= rank_a then rank_h else rank_a end as effective_rank,
    case when rank_h >= rank_a then r_h else r_a end as primary_, case when rank_h >= rank_a then r_a else r_h end as secondary_,
    case when rank_h >= rank_a then prob_h else prob_a end as final_prob from calls)"""


def calls(spark, d):
    c = table(spark, d, "customer")
    n, key = c.agg(F.count("*")).scalar(), F.col("c_custkey")

    def node(x):
        return F.concat(F.lit("C"), x % n, F.lit(".1"))

    return c.select(F.concat(F.lit("C"), key, F.lit(".1")).alias("query"), node(key * 3 + 1).alias("r_h"),
                    node(key * 5 + 2).alias("r_a"), (key % 4).cast("int").alias("rank_h"),
                    ((key * 7 + 1) % 4).cast("int").alias("rank_a"), (F.lit(0.5) + (key % 50) / F.lit(100.0)).alias("prob_h"),
                    (F.lit(0.5) + (key % 37) / F.lit(100.0)).alias("prob_a"))


@query("final_rank_choice", oracle(f"""with {CALLS_SQL} select query, effective_rank, primary_ as "primary", secondary_ as secondary,
    round(final_prob, 6) as final_prob from chosen"""))
def _(spark, d):
    return rounded(N.final_rank_choice(calls(spark, d)).select(
        "query", "effective_rank", "primary", "secondary", "final_prob"), "final_prob")


def _known(c: str) -> str:
    return f"case when lower(trim({c})) not in ('', 'nan', 'na', 'unknown') then {c} end"


RECON_SQL = CALLS_SQL + ", recon as (select chosen.*, " + ", ".join(
    f"case when effective_rank >= {n} then coalesce({_known('p.' + r)}, '') else '' end as {r}"
    for n, r in enumerate(LINEAGE, 1)) + """ from chosen left join v_taxa p on p.Accession = primary_)"""


@query("reconcile_taxonomy", oracle(f"with {RECON_SQL} select query, '' as \"NR\", {', '.join(LINEAGE)} from recon", "v_taxa"))
def _(spark, d):
    chosen = N.final_rank_choice(calls(spark, d))
    return T.reconcile_taxonomy(chosen, spark_view(spark, d, "v_taxa"), PROFILE).select("query", "NR", *LINEAGE)


_NAME = "case {0} when 0 then 'NR' when 1 then 'Family' when 2 then 'Subfamily' when 3 then 'Genus' end"
EDGE_TO = """left join und {0} on {0}.source = least(concat(split_part(query, '.', 1), '.1'), {1}) and {0}.target = greatest(concat(split_part(query, '.', 1), '.1'), {1})"""
REPORT_SQL = f"""{UND_SQL}, {RECON_SQL}, nodes as (select source as node from und union select target from und),
    rep as (select query, r_h as closest_node_1_r_hyp, r_a as closest_node_2_r_ani, 'hyp_adj' as neighbor_source_node1, 'ani_adj' as neighbor_source_node2,
    e.weight as ani_edge_to_node1, e.weight as hyp_edge_to_node1, f.weight as ani_edge_to_node2, f.weight as hyp_edge_to_node2,
    {_NAME.format('rank_h')} as initial_relationship_to_node1, printf('%.4f', prob_h::double) as initial_pred_prob_to_node1,
    {_NAME.format('rank_a')} as initial_relationship_to_node2, printf('%.4f', prob_a::double) as initial_pred_prob_to_node2,
    primary_ as chosen_node_for_final_rank, {_NAME.format('effective_rank')} as final_relationship, printf('%.4f', final_prob::double) as final_pred_prob,
    {', '.join(LINEAGE)} from recon {EDGE_TO.format('e', 'r_h')} {EDGE_TO.format('f', 'r_a')})"""


def report(spark, d):
    """Result table for fixed predictions; a query has a vector if it has a strong edge, every eleventh has no references."""
    graph = G.undirected_max(spark_view(spark, d, "v_edges"))
    graph = graph.withColumns({c: F.regexp_replace(c, r"\.1$", "") for c in ("source", "target")})
    meta = spark_view(spark, d, "v_taxa").withColumn("Accession", F.split_part("Accession", F.lit("."), F.lit(1)))
    fixed = calls(spark, d).withColumns({c: F.split_part(c, F.lit("."), F.lit(1)) for c in ("r_h", "r_a")}).withColumn(
        "node", F.split_part("query", F.lit("."), F.lit(1)))
    found = F.substring("node", 2, 18).cast("bigint") % 11 != 0
    selected = fixed.select("node", *[F.when(found, F.col(c)).alias(c) for c in ("r_h", "r_a")],
                            F.when(found, "hyp_adj").otherwise("unknown").alias("sel_h"), F.when(found, "ani_adj").otherwise("unknown").alias("sel_a"))
    strong = graph.where("weight > 0.9")
    return N.classification_report(
        fixed.select("query"), selected, fixed.select("node", "rank_h", "prob_h", "rank_a", "prob_a"), meta, PROFILE,
        graph, graph, G.node_set(strong))


_STRIP = ("closest_node_1_r_hyp", "closest_node_2_r_ani", "chosen_node_for_final_rank")


def report_sql(columns: str, more: str = "") -> str:
    nulls = ", ".join(["null"] * columns.count(","))
    strip = ", ".join(f"split_part({c}, '.', 1) as {c}" for c in _STRIP)
    return f"""with {REPORT_SQL}, strong as (select source as node from und where weight > 0.9 union select target from und where weight > 0.9),
    lost as (select query, cast(substring(split_part(query, '.', 1), 2) as bigint) % 11 = 0 as lost from calls),
    good as (select * replace ({strip}) from rep where query in (select node from strong) and query in (select query from lost where not lost))
    select {columns}, null as error, null as rh_f, null as ra_f, null as sel_h, null as sel_a{more} from good
    union all select query, {nulls}, 'No query embedding in combined set', null, null, null, null{more} from calls where query not in (select node from strong)
    union all select query, {nulls}, 'Insufficient valid neighbors for final prediction', 'None', 'None', 'unknown', 'unknown'{more} from lost
    where lost and query in (select node from strong)"""


_REPORT_COLUMNS = ", ".join([
    "query", "closest_node_1_r_hyp", "closest_node_2_r_ani", "neighbor_source_node1", "neighbor_source_node2",
    "ani_edge_to_node1", "hyp_edge_to_node1", "ani_edge_to_node2", "hyp_edge_to_node2", "initial_relationship_to_node1",
    "initial_pred_prob_to_node1", "initial_relationship_to_node2", "initial_pred_prob_to_node2",
    "chosen_node_for_final_rank", "final_relationship", "final_pred_prob", *LINEAGE])


@query("classification_report", oracle(report_sql(_REPORT_COLUMNS), "v_edges", "v_taxa"))
def _(spark, d):
    return report(spark, d)


_HEADER = _REPORT_COLUMNS.replace(" ", "") + ",error,rh_f,ra_f,sel_h,sel_a"


@query("write_results", oracle(report_sql(_REPORT_COLUMNS, f", '{_HEADER}' as header"), "v_edges", "v_taxa"))
def _(spark, d):
    from kinweave.sources import staging, writers
    path = staging.scratch_path(spark, "results")
    out = report(spark, d)
    writers.write_results(out, path, PROFILE)
    back = spark.read.option("header", True).csv(path)
    ranks = {r: F.when(F.col("error").isNull(), F.coalesce(r, F.lit(""))) for r in LINEAGE}
    typed = back.withColumns(ranks).select(*[F.col(f.name).cast(f.dataType) for f in out.schema])
    return typed.withColumn("header", F.lit(",".join(back.columns)))


@query("select_two_neighbors", oracle("""with und as (select least(source, target) as source, greatest(source, target) as target, max(weight) as weight
    from v_edges where source <> target group by 1, 2),
    b as (select source as node, target as nb, weight as h, 1 - weight as a from und union all select target, source, weight, 1 - weight from und),
    qs as (select Accession as node from v_taxa where Family = 'Unknown'), al as (select Accession as node from v_taxa where Family <> 'Unknown'),
    hr as (select *, row_number() over (partition by node order by h desc, nb) as rk from b where node in (select node from qs)),
    ar as (select *, row_number() over (partition by node order by a desc, nb) as rk from b where node in (select node from qs)),
    h1 as (select node, min_by(nb, rk) as h_adj from hr where rk <= 50 and nb in (select node from al) group by node),
    a1 as (select ar.node, min_by(nb, rk) as a_adj from ar left join h1 using (node) where rk <= 50 and nb in (select node from al)
    and (h_adj is null or nb <> h_adj) group by ar.node),
    em as (select concat('C', vec_id, '.1') as node, list_transform(embedding, lambda x: x::double) as v from embeddings),
    half as (select node, v[33:64] as h, v[1:32] as a from em),
    qe as (select half.* from half join qs using (node)), re as (select half.* from half join al using (node)),
    hc as (select q.node, r.node as nb, row_number() over (partition by q.node order by round(list_dot_product(q.h, r.h) /
      (sqrt(list_dot_product(q.h, q.h)) * sqrt(list_dot_product(r.h, r.h))), 9) desc, r.node) as rk from qe q, re r where q.node not in (select node from h1)),
    ac as (select q.node, r.node as nb, row_number() over (partition by q.node order by round(list_dot_product(q.a, r.a) /
      (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(r.a, r.a))), 9) desc, r.node) as rk from qe q, re r where q.node not in (select node from a1)),
    base as (select qs.node, h_adj, a_adj, coalesce(h_adj, hc.nb) as rh,
      case when h_adj is not null then 'hyp_adj' when hc.nb is not null then 'cosine_h' else 'unknown' end as th
      from qs left join h1 using (node) left join a1 using (node) left join hc on hc.node = qs.node and hc.rk = 1),
    a2 as (select ac.node, min_by(nb, rk) as a_cos from ac join base using (node) where rk <= 2 and (rh is null or nb <> rh) group by ac.node),
    f as (select base.*, coalesce(a_adj, a_cos) as ra, case when a_adj is not null then 'ani_adj' when a_cos is not null then 'cosine_a' else 'unknown' end as ta
      from base left join a2 using (node))
    select node, coalesce(rh, ra) as r_h, coalesce(ra, rh) as r_a, case when rh is null and ra is not null then concat('reuse_a_as_h(', ta, ')') else th end as sel_h,
    case when ra is null and rh is not null then concat('reuse_h_as_a(', th, ')') else ta end as sel_a from f""", "v_edges", "v_taxa"))
def _(spark, d):
    hyp = G.undirected_max(spark_view(spark, d, "v_edges"))
    ani = hyp.withColumn("weight", 1 - F.col("weight"))
    taxa = spark_view(spark, d, "v_taxa").select(F.col("Accession").alias("node"), "Family")
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("C"), "vec_id", F.lit(".1")).alias("node"), F.col("embedding").alias("emb"))
    return N.select_two_neighbors(taxa.where("Family = 'Unknown'").select("node"), hyp, ani,
                                  taxa.where("Family <> 'Unknown'").select("node"), vectors, 32)
