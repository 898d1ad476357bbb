"""Queries over hit tables, set sharing and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.functions.columns import strip_version
from kinweave.operators import hits as H
from kinweave.operators import sharing as S
from kinweave.operators import sketch as K
from kinweave.plans.graphs import build_graphs, hallmark_network, sketch_graph
from kinweave.plans.params import WorkflowParams

ALL = "pident, alnlen, mismatch, numgapopen, qstart, qend, tstart, tend, evalue, bitscore, qlen, tlen"
TOP = ["query", "target", "pident", "alnlen", "qstart", "qend", "evalue", "bitscore"]


@query("best_hit", oracle(f"""select {', '.join(TOP)} from (select *, row_number() over (partition by query, target
    order by evalue, -bitscore, {ALL}) as rn from v_hits where evalue <= 1e-5 and bitscore >= 50) where rn = 1""", "v_hits"))
def _(spark, d):
    return H.best_hit(spark_view(spark, d, "v_hits")).select(*TOP)


@query("best_hit_by_bitscore", oracle(f"""select {', '.join(TOP)} from (select *, row_number() over (partition by query, target
    order by -bitscore, {ALL}) as rn from v_hits where bitscore >= 50) where rn = 1""", "v_hits"))
def _(spark, d):
    return H.best_hit_by_bitscore(spark_view(spark, d, "v_hits")).select(*TOP)


GREEDY_SQL = """ranked as (select *, row_number() over (partition by query, target order by -(pident * alnlen), qstart, qend,
    pident, alnlen, mismatch, numgapopen, tstart, tend, evalue, bitscore, qlen, tlen) as rn from v_hits),
    greedy as (select query, target, rn, true as kept, [{'s': qstart, 'e': qend}] as occ from ranked where rn = 1
    union all select r.query, r.target, r.rn, not o.hit, case when o.hit then g.occ
    else list_append(g.occ, {'s': r.qstart, 'e': r.qend}) end
    from greedy g join ranked r on r.query = g.query and r.target = g.target and r.rn = g.rn + 1,
    lateral (select len(list_filter(g.occ, lambda x: r.qstart < x.e and x.s < r.qend)) > 0 as hit) o),
    kept as (select r.* from ranked r join greedy g using (query, target, rn) where g.kept)"""


@query("greedy_overlap_filter", oracle(f"""with recursive {GREEDY_SQL}
    select query, target, pident, alnlen, qstart, qend, evalue from kept""", "v_hits"))
def _(spark, d):
    return H.greedy_overlap_filter(spark_view(spark, d, "v_hits")).select(
        "query", "target", "pident", "alnlen", "qstart", "qend", "evalue")


@query("ani_simple", oracle("""select query, target, round(sum(pident * alnlen) / sum(alnlen) / greatest(min(qlen), min(tlen)) * sum(alnlen), 6) as "ANI"
    from v_hits group by query, target""", "v_hits"))
def _(spark, d):
    return H.ani_simple(spark_view(spark, d, "v_hits")).withColumn("ANI", F.round("ANI", 6))


@query("ani_nonoverlap", oracle(f"""with recursive {GREEDY_SQL} select query as source, target,
    round(greatest(power(sum(pident / 100 * alnlen) / sum(alnlen), 2), 0.2), 6) as identity,
    round(greatest(sum(alnlen)::double / min(least(qlen, tlen)), 0.05), 6) as coverage from kept group by query, target""", "v_hits"))
def _(spark, d):
    hits = spark_view(spark, d, "v_hits")
    floors = {"identity": 0.2, "coverage": 0.05}
    return H.nonoverlap_weights(hits, identity_scale=100.0).withColumns(
        {c: F.round(F.greatest(c, F.lit(low)), 6) for c, low in floors.items()})


@query("ani_weight", oracle("""select split_part(concat(query, ' genome'), ' ', 1) as source, target,
    round(avg(pident) * greatest(max(100.0 * alnlen / qlen), max(100.0 * alnlen / tlen)) / 10000, 9) as weight,
    round(avg(pident), 9) as raw from v_hits group by query, target""", "v_hits"))
def _(spark, d):
    pairs = spark_view(spark, d, "v_hits").groupBy(
        F.concat("query", F.lit(" genome")).alias("Query_name"), F.col("target").alias("Ref_name")).agg(
        F.avg("pident").alias("ANI"), F.max(100.0 * F.col("alnlen") / F.col("qlen")).alias("Align_fraction_query"),
        F.max(100.0 * F.col("alnlen") / F.col("tlen")).alias("Align_fraction_ref"))
    raw = H.ani_weight(pairs, use_fractions=False).withColumnRenamed("weight", "raw")
    return H.ani_weight(pairs).join(raw, ["source", "target"]).withColumns(
        {"weight": F.round("weight", 9), "raw": F.round("raw", 9)})


# --- presence/absence and set sharing ------------------------------------------------------

@query("presence_absence", oracle("""select distinct split_part(query, '.', 1) as query, target from v_hits
    where evalue <= 1e-5 and bitscore >= 50""", "v_hits"))
def _(spark, d):
    hits = H.hit_threshold_filter(spark_view(spark, d, "v_hits"))
    return S.presence_absence(hits.withColumn("query", strip_version("query")))


UBIQ_SQL = """kept as (select v.* from v_items v join (select target from v_items group by target
    having count(*) <= ceil(0.8 * (select count(distinct query) from v_items))) using (target))"""


@query("ubiquity_filter", oracle(f"with {UBIQ_SQL} select query, target from kept", "v_items"))
def _(spark, d):
    return S.ubiquity_filter(spark_view(spark, d, "v_items"))


@query("set_size", oracle(f"with {UBIQ_SQL} select query, count(*) as size from kept group by query", "v_items"))
def _(spark, d):
    return S.set_size(S.ubiquity_filter(spark_view(spark, d, "v_items")))


@query("shared_item_pairs", oracle(f"""with {UBIQ_SQL} select l.query as i, r.query as j, count(*) as c
    from kept l join kept r on l.target = r.target and l.query < r.query group by 1, 2""", "v_items"))
def _(spark, d):
    return S.shared_item_pairs(S.ubiquity_filter(spark_view(spark, d, "v_items")))


def tested_sql(source: str, universe: str) -> str:
    """CTEs ending in tail(i, j, c, a, b, log_p) over a presence table."""
    return f"""sizes as (select query, count(*) as n from {source} group by query),
    un as (select count(distinct target) as u from {universe}),
    pairs as (select l.query as i, r.query as j, count(*) as c from {source} l join {source} r
    on l.target = r.target and l.query < r.query group by 1, 2),
    trip as (select i, j, c, x.n as a, y.n as b from pairs join sizes x on x.query = i join sizes y on y.query = j),
    terms as (select a, b, c, lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)
    + lgamma(u - a + 1) - lgamma(b - k + 1) - lgamma(u - a - b + k + 1)
    - lgamma(u + 1) + lgamma(b + 1) + lgamma(u - b + 1) as t
    from (select distinct a, b, c from trip) d, un, lateral (select unnest(range(c, least(a, b) + 1)) as k) s
    where u - a - b + k >= 0),
    tops as (select a, b, c, max(t) as m from terms group by a, b, c),
    tails as (select a, b, c, max(m) + ln(sum(exp(t - m))) as log_p from terms join tops using (a, b, c) group by a, b, c),
    tail as (select * from trip join tails using (a, b, c))"""


@query("hypergeom_edges", oracle(f"""with {UBIQ_SQL}, {tested_sql('kept', 'kept')}
    select i as source, j as target, round(-log_p / ln(10), 5) as weight, round(c / least(a, b), 6) as ratio
    from tail where log_p <= ln(0.1)""", "v_items"))
def _(spark, d):
    pairs = S.hypergeom_pairs(spark_view(spark, d, "v_items"))
    return pairs.select("source", "target", F.round(S.pair_weight(), 5).alias("weight"),
                        F.round(S.pair_weight("ratio"), 6).alias("ratio"))


@query("hypergeom_edges_legacy", oracle(f"""with sz as (select query from v_items group by query having count(*) >= 20),
    kept as (select v.* from v_items v join sz using (query)), {tested_sql('kept', 'v_items')}
    select i as source, j as target, round(-ln(exp(log_p) + 1e-15), 5) as weight from tail where log_p <= ln(0.05)""", "v_items"))
def _(spark, d):
    out = S.hypergeom_edges_legacy(spark_view(spark, d, "v_items"), min_items=20)
    return out.withColumn("weight", F.round("weight", 5))


@query("edge_diagnostics", oracle(f"""with {UBIQ_SQL}, {tested_sql('kept', 'kept')},
    n as (select count(distinct query) as n from v_items)
    select cast(n * (n - 1) / 2 as bigint) as total_pairs, (select count(*) from tail where log_p <= ln(0.1)) as nonzero_pairs,
    cast(n * (n - 1) / 2 as bigint) - (select count(*) from tail where log_p <= ln(0.1)) as zero_pairs from n""", "v_items"))
def _(spark, d):
    pa = spark_view(spark, d, "v_items")
    return S.edge_diagnostics(S.hypergeom_edges(pa), pa.agg(F.count_distinct("query")).scalar())


@query("merge_presence_absence", oracle("""select query, target from v_items union
    select distinct split_part(query, '.', 1), target from v_hits""", "v_items", "v_hits"))
def _(spark, d):
    hits = spark_view(spark, d, "v_hits").withColumn("query", strip_version("query"))
    return S.merge_presence_absence(spark_view(spark, d, "v_items"), S.presence_absence(hits))


def cover_sql(source: str) -> str:
    """CTEs of the greedy cover, three picks per round until nothing is left; they need WITH RECURSIVE."""
    top = "select target from cover group by target order by count(*) desc, target limit 3"
    return f"""cover(round, query, target) as (select 0, query, target from {source} union all select round + 1, query, target from cover
    where target not in ({top}) and query not in (select query from cover where target in ({top}))),
    picks as (select round, cast(position as int) as position, target, freq from (select round, target, count(*) as freq,
    row_number() over (partition by round order by count(*) desc, target) - 1 as position from cover group by round, target) where position < 3)"""


@query("hallmark_items", oracle(f"with recursive {cover_sql('v_items')} select round, position, target, freq from picks", "v_items"))
def _(spark, d):
    return S.hallmark_items(spark_view(spark, d, "v_items"))


# --- sketches and seeds --------------------------------------------------------------------

def kmer_sql(view: str, k: int) -> str:
    return f"""select id, pos, substring(seq, pos, {k}) as kmer from {view},
    lateral (select unnest(range(1, length(seq) - {k} + 2)) as pos) p"""


@query("kmer_sketch", oracle(f"""with h as (select distinct id, md5(kmer) as hash from ({kmer_sql('v_seq', 11)}))
    select id, rank, hash from (select id, hash, row_number() over (partition by id order by hash) as rank from h) where rank <= 64""", "v_seq"))
def _(spark, d):
    out = K.kmer_sketch(spark_view(spark, d, "v_seq"), 11, 64)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("sketch_ani", oracle(f"""with q as (select distinct id, kmer as hash from ({kmer_sql('v_bench', 11)})),
    r as (select distinct id, kmer as hash from ({kmer_sql('v_seq', 11)})),
    nq as (select id, count(*) as n from q group by id), nr as (select id, count(*) as n from r group by id),
    s as (select q.id as qi, r.id as ri, count(*) as c from q join r using (hash) group by 1, 2),
    x as (select qi, ri, c, nq.n as a, nr.n as b, c / (nq.n + nr.n - c) as j from s join nq on nq.id = qi join nr on nr.id = ri)
    select qi as "Query_name", ri as "Ref_name", round(greatest(100 * (1 + ln(2 * j / (1 + j)) / 11), 0), 6) as "ANI",
    round(100.0 * c / a, 6) as "Align_fraction_query", round(100.0 * c / b, 6) as "Align_fraction_ref" from x""", "v_bench", "v_seq"))
def _(spark, d):
    out = K.sketch_ani(K.kmer_sets(spark_view(spark, d, "v_bench")), K.kmer_sets(spark_view(spark, d, "v_seq")))
    return out.select("Query_name", "Ref_name", *[F.round(c, 6).alias(c) for c in (
        "ANI", "Align_fraction_query", "Align_fraction_ref")])


@query("sketch_graph", oracle(f"""with q as (select distinct id, kmer from ({kmer_sql('v_seq', 11)})),
    n as (select id, count(*) as n from q group by id),
    s as (select a.id as source, b.id as target, count(*) as c from q a join q b on a.kmer = b.kmer and a.id < b.id group by 1, 2),
    x as (select source, target, c, a.n as a, b.n as b, c / (a.n + b.n - c) as j from s join n a on a.id = source join n b on b.id = target)
    select split_part(source, '.', 1) as source, split_part(target, '.', 1) as target, round(greatest(100 * (1 + ln(2 * j / (1 + j)) / 11), 0) * 100.0 * c / least(a, b) / 10000, 9) as weight from x""", "v_seq"))
def _(spark, d):
    return sketch_graph(spark_view(spark, d, "v_seq"), WorkflowParams()).withColumn("weight", F.round("weight", 9))


@query("seed_hits", oracle(f"""with rp as ({kmer_sql('v_bench', 11)}),
    common as (select kmer from rp group by kmer having count(distinct id) > ceil(0.8 * (select count(*) from v_bench))),
    ref as (select id as target, kmer, count(*) as places from rp where kmer not in (select kmer from common) group by 1, 2),
    tot as (select id as target, count(*) as total from rp group by id),
    seeds as (select id as query, kmer, min(pos) as f, max(pos) as l from ({kmer_sql('v_seq', 11)}) group by 1, 2),
    m as (select query, target, sum(places) as matched, min(f) as qstart, max(l) + 10 as qend from seeds join ref using (kmer) group by 1, 2)
    select query, target, cast(matched as bigint) as matched, round(100 * power(matched / total, 1.0::double / 11), 6) as identity,
    round(100.0 * matched / total, 6) as cover, cast(qstart as bigint) as qstart, cast(qend as bigint) as qend
    from m join tot using (target) where 100 * power(matched / total, 1.0::double / 11) >= 60 and 100.0 * matched / total >= 50""", "v_bench", "v_seq"))
def _(spark, d):
    out = K.seed_hits(spark_view(spark, d, "v_seq"), spark_view(spark, d, "v_bench"))
    return out.select("query", "target", "matched", F.round("identity", 6).alias("identity"),
                      F.round("cover", 6).alias("cover"), F.col("qstart").cast("bigint").alias("qstart"),
                      F.col("qend").cast("bigint").alias("qend"))


# --- workflows -----------------------------------------------------------------------------

@query("build_graphs", oracle(f"""with recursive bare as materialized (select * replace (split_part(query, '.', 1) as query, split_part(target, '.', 1) as target) from v_hits),
    {GREEDY_SQL.replace('from v_hits', 'from bare')}, v_best as (select distinct split_part(query, '.', 1) as query, target from v_hits
    where evalue <= 1e-5 and bitscore >= 50), pa as (select v.* from v_best v join (select target from v_best group by target
    having count(*) <= ceil(0.8 * (select count(distinct query) from v_best))) using (target)), {tested_sql('pa', 'pa')}
    select 'gene' as graph, i as source, j as target, round(-log_p / ln(10), 5) as weight from tail
    where log_p <= ln(0.1) and log_p < 0
    union all select 'ani', query, target, round(greatest(sum(alnlen)::double / min(least(qlen, tlen)), 0.2), 9) from kept group by query, target""", "v_hits"))
def _(spark, d):
    hits = spark_view(spark, d, "v_hits")
    return build_graphs(hits, hits, WorkflowParams()).withColumn(
        "weight", F.when(F.col("graph") == "gene", F.round("weight", 5)).otherwise(F.round("weight", 9)))


@query("hallmark_network", oracle(f"""with recursive best as materialized (select query, target, qstart, qend from (select *, row_number() over (partition by query, target
    order by -bitscore, qstart, qend, bitscore) as rn from v_gene_hits where bitscore >= 50) where rn = 1),
    pa as materialized (select target as query, query as target from best where query in (select query from best group by query having count(*) >= 2)),
    {tested_sql('pa', 'pa')}, shared as materialized (select i, j, -ln(exp(log_p) + 1e-15) as weight from tail where log_p <= ln(0.05)),
    {cover_sql('pa')},
    sl as materialized (select gene, id, string_split(s, '') as s from (select best.query as gene, best.target as id, substring(seq, qstart, qend - qstart + 1) as s
    from best join v_seq on v_seq.id = best.target where best.query in (select target from picks)) where length(s) > 0),
    dists as (select i, j, 1.0 - list_sum([(x[1] = x[2])::int for x in list_zip(l.s, r.s)]) / len(l.s) as dist
    from shared join sl l on l.id = i join sl r on r.id = j and r.gene = l.gene where len(l.s) = len(r.s)),
    mean as (select i, j, avg(dist) as dist from dists group by i, j)
    select i as source, j as target, round(weight, 5) as weight, round(coalesce(dist, 1.0), 6) as dist,
    round(coalesce(least(greatest(1 - dist, 0), 1), 0.0), 6) as dist_weight from shared left join mean using (i, j)""", "v_gene_hits", "v_seq"))
def _(spark, d):
    hits = spark_view(spark, d, "v_gene_hits").select("query", "target", "qstart", "qend", "bitscore")
    out = hallmark_network(hits, spark_view(spark, d, "v_seq"))
    return out.withColumns({"weight": F.round("weight", 5), "dist": F.round("dist", 6),
                            "dist_weight": F.round("dist_weight", 6)})
