"""Queries over weighted graphs and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.functions.rng import hash_order_sql, uniform_sql
from kinweave.operators import graph as G
from kinweave.operators import embeddings, neighbors, walks
from kinweave.operators.taxonomy import relationship_bounds

UND_SQL = """und as (select least(source, target) as source, greatest(source, target) as target, max(weight) as weight
    from v_edges where source <> target group by 1, 2)"""
SYM_SQL = f"""{UND_SQL}, nodes as (select source as node from und union select target from und),
    sym as (select source, target, weight from und union all select target, source, weight from und
    union all select node, node, (select max(weight) from und) from nodes)"""


@query("undirected_max", oracle(f"with {UND_SQL} select source, target, weight from und", "v_edges"))
def _(spark, d):
    return G.undirected_max(spark_view(spark, d, "v_edges"))


@query("node_set", oracle("select source as node from v_edges union select target from v_edges", "v_edges"))
def _(spark, d):
    return G.node_set(spark_view(spark, d, "v_edges"))


@query("union_edges", oracle("""select source, target, weight, null as origin from v_edges union all
    select target, source, weight, 'reverse' from v_edges""", "v_edges"))
def _(spark, d):
    edges = spark_view(spark, d, "v_edges")
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight",
                           F.lit("reverse").alias("origin"))
    return G.union_edges(edges, reverse)


@query("symmetrize_with_loops", oracle(f"with {SYM_SQL} select source, target, weight from sym", "v_edges"))
def _(spark, d):
    return G.symmetrize_with_loops(spark_view(spark, d, "v_edges"))


@query("topk_neighbors", oracle(f"""with {UND_SQL}, b as (select source as node, target as neighbor, weight from und
    union all select target, source, weight from und)
    select node, neighbor, weight, rank from (select *, row_number() over (partition by node order by weight desc, neighbor) as rank
    from b) where rank <= 50""", "v_edges"))
def _(spark, d):
    out = G.topk_neighbors(spark_view(spark, d, "v_edges"))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


INDEX_SQL = f"""idx as (select node, row_number() over (order by {hash_order_sql('node', 'node')}, node) - 1 as node_id
    from (select source as node from sym union select target from sym))"""


@query("index_nodes", oracle(f"""with {SYM_SQL}, {INDEX_SQL} select s.node_id as source_id, t.node_id as target_id, weight
    from sym join idx s on s.node = source join idx t on t.node = target""", "v_edges"))
def _(spark, d):
    edges = G.symmetrize_with_loops(spark_view(spark, d, "v_edges"))
    return G.relabel_edges(edges, G.index_nodes(edges))


def adjacency_sql(edges: str, source: str, target: str) -> str:
    return f"""masses as (select node, neighbor, cast(greatest(round(weight / max(weight) over (partition by node) * 1000000000), 1) as bigint) as mass
    from (select {source} as node, {target} as neighbor, max(weight) as weight from {edges} where weight > 0 group by 1, 2)),
    adj as materialized (select node, neighbor, mass, cast(coalesce(sum(mass) over (partition by node order by {hash_order_sql('adj', 'neighbor')}, neighbor
    rows between unbounded preceding and 1 preceding), 0) as bigint) as before, count(*) over (partition by node) as degree,
    cast(sum(mass) over (partition by node) as bigint) as total from masses)"""


@query("adjacency", oracle(f"""with {SYM_SQL}, {adjacency_sql('sym', 'source', 'target')}
    select node, neighbor, mass, before, degree, total from adj""", "v_edges"))
def _(spark, d):
    return G.adjacency(G.symmetrize_with_loops(spark_view(spark, d, "v_edges")))


_DRAW_U = uniform_sql("cast(o_orderkey as bigint)", "cast(0 as bigint)", 7)


@query("weighted_draw", oracle(f"""with {SYM_SQL}, {adjacency_sql('sym', 'source', 'target')},
    draws as (select o_orderkey as id, concat('C', o_custkey, '.1') as node, {_DRAW_U} as u from orders)
    select id, d.node, a.neighbor from draws d join adj a on a.node = d.node
    and cast(floor(u * total) as bigint) >= before and cast(floor(u * total) as bigint) < before + mass""", "v_edges"))
def _(spark, d):
    adj = G.adjacency(G.symmetrize_with_loops(spark_view(spark, d, "v_edges")))
    draws = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(
        F.lit("C"), "o_custkey", F.lit(".1")).alias("node"), F.expr(_DRAW_U).alias("u"))
    return G.weighted_draw(draws, adj)


@query("restrict_edges", oracle("""with n as (select Accession as node from v_taxa where Family = 'ASIA' or Family = 'EUROPE')
    select source, target, weight from v_edges where source in (select node from n) and target in (select node from n)""",
    "v_edges", "v_taxa"))
def _(spark, d):
    nodes = spark_view(spark, d, "v_taxa").where("Family in ('ASIA', 'EUROPE')").select(F.col("Accession").alias("node"))
    return G.restrict_edges(spark_view(spark, d, "v_edges"), nodes)


@query("semi_filter", oracle("""select row_no, true as inside from v_taxa where Accession in (select source from v_edges where weight > 0.9)
    union all select row_no, false from v_taxa where Accession not in (select source from v_edges where weight > 0.9)""",
    "v_edges", "v_taxa"))
def _(spark, d):
    taxa = spark_view(spark, d, "v_taxa")
    ids = spark_view(spark, d, "v_edges").where("weight > 0.9")
    inside = G.semi_filter(taxa, ids, "Accession", "source").select("row_no", F.lit(True).alias("inside"))
    return inside.union(G.semi_filter(taxa, ids, "Accession", "source", negate=True).select("row_no", F.lit(False)))


@query("edge_first_sample", oracle(f"""with h as (select source, target, cast(round(weight * 100000000) as bigint) as units from v_edges),
    r as (select *, {hash_order_sql('sample', 'source', 'target', 'units')} as hash from h),
    f as (select node, min(hash) as first from (select source as node, hash from r union all select target, hash from r) group by node),
    c as (select max(first) as last from (select first from f order by first limit 100))
    select source, target, units from r, c where hash <= last""", "v_edges"))
def _(spark, d):
    edges = spark_view(spark, d, "v_edges").select(
        "source", "target", F.round(F.col("weight") * 100000000).cast("bigint").alias("units"))
    return G.edge_first_sample(edges, 100)


@query("induced_subgraph", oracle(f"""with {UND_SQL}, n as (select node from (select source as node from v_edges union select target from v_edges)
    order by {hash_order_sql('nodes', 'node')}, node limit 300),
    i as (select * from und where source in (select node from n) and target in (select node from n))
    select source, target, weight, round(0.2 * weight / (select max(weight) from i), 6) as width,
    coalesce(nullif(trim(s.Subfamily), ''), 'Unknown') as source_taxon, coalesce(nullif(trim(t.Subfamily), ''), 'Unknown') as target_taxon
    from i left join v_taxa s on s.Accession = source left join v_taxa t on t.Accession = target""", "v_edges", "v_taxa"))
def _(spark, d):
    edges = spark_view(spark, d, "v_edges")
    out = G.induced_subgraph(edges, G.sample_nodes(edges, 300), spark_view(spark, d, "v_taxa"), "Subfamily")
    return out.withColumn("width", F.round("width", 6))


# --- walks ---------------------------------------------------------------------------------

WALKS, LENGTH, SEED = 200, 10, 42
_U_MOVE = uniform_sql("w.walk_id", "2 * w.draw", SEED)
_U_TAKE = uniform_sql("w.walk_id", "2 * w.draw + 1", SEED)


_WALK_SQL = f"""{SYM_SQL}, {INDEX_SQL},
    rel as (select s.node_id as source_id, t.node_id as target_id, weight from sym join idx s on s.node = source join idx t on t.node = target),
    {adjacency_sql('rel', 'source_id', 'target_id')},
    w as (select node_id * {WALKS} + g as walk_id, cast(null as bigint) as prev, node_id as cur, cast(0 as bigint) as draw,
      0 as step, true as moved from idx, lateral (select unnest(range({WALKS})) as g) s
    union all
    select walk_id, case when ok then cur else prev end, case when ok then nxt else cur end, draw + 1, step + ok::int, ok from (
      select w.*, a.neighbor as nxt, {_U_TAKE} * 2.0 < case when w.prev is null then 2.0 when a.neighbor = w.prev then 2.0
        when l.node is not null then 1.0 else 0.5 end as ok
      from w join adj a on a.node = w.cur and floor({_U_MOVE} * a.total) >= a.before and floor({_U_MOVE} * a.total) < a.before + a.mass
      left join adj l on l.node = w.prev and l.neighbor = a.neighbor where w.step < {LENGTH}))"""


@query("biased_random_walk", oracle(f"""with recursive {_WALK_SQL}
    select walk_id, step, idx.node from w join idx on idx.node_id = w.cur where moved""", "v_edges"))
def _(spark, d):
    edges = G.symmetrize_with_loops(spark_view(spark, d, "v_edges"))
    out = walks.biased_random_walk(edges, LENGTH, 0.5, 2.0, WALKS, SEED)
    return out.select("walk_id", F.posexplode("nodes").alias("step", "node"))


@query("walk_pairs", oracle(f"""with recursive {_WALK_SQL}, s as materialized (select walk_id, step, cur from w where moved)
    select a.cur as centre, b.cur as context, cast(sum(6 - abs(a.step - b.step)) as bigint) as n
    from s a join s b on a.walk_id = b.walk_id and a.step <> b.step and abs(a.step - b.step) <= 5 group by 1, 2""", "v_edges"))
def _(spark, d):
    edges = G.symmetrize_with_loops(spark_view(spark, d, "v_edges"))
    return embeddings.walk_pairs(walks.walk_ids(G.relabel_edges(edges, G.index_nodes(edges)), LENGTH, 0.5, 2.0, WALKS, SEED, lists=True))


@query("node_embeddings")
def _(spark, d):
    edges = G.symmetrize_with_loops(spark_view(spark, d, "v_edges"))
    return embeddings.node_embeddings(edges)


# --- nearest neighbours by vector ----------------------------------------------------------

@query("cosine_nearest", oracle("""with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
    n as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as s from e),
    p as (select q.vec_id as query, r.vec_id as ref, round(list_dot_product(q.v, r.v) / (q.s * r.s), 9) as sim
    from n q join n r on (q.label < 2) and (r.label >= 2))
    select query, ref, round(sim, 6) as sim, rank from (select *, row_number() over (partition by query order by sim desc, ref) as rank from p)
    where rank <= 2"""))
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "label", F.col("embedding").alias("emb"))
    out = neighbors.cosine_nearest(e.where("label < 2"), e.where("label >= 2"), k=2, query_rows=64, ref_rows=128)
    return out.select("query", "ref", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))
