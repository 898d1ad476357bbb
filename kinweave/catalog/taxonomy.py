"""Queries over lineage tables, assemblies and relationship bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.functions.columns import strip_version
from kinweave.operators import hits as H
from kinweave.operators import metrics as M
from kinweave.operators import taxonomy as T
from kinweave.plans.references import prepare_reference_set

RANKS = ("Class", "Family", "Subfamily", "Genus", "Species")
FALLBACK = ("Family", "asia")


def clean(c: str) -> str:
    return (f"case when lower(trim({c})) not in ('', 'unknown', 'unclassified', 'none', '<na>', 'na', 'null', 'nan') "
            f"then lower(trim({c})) end")


@query("keep_first", oracle("""select Subfamily, Genus, Accession, row_no from (select *, row_number() over (partition by Subfamily, Genus
    order by row_no) as rn from v_taxa) where rn = 1""", "v_taxa"))
def _(spark, d):
    return H.keep_first(spark_view(spark, d, "v_taxa"), ["Subfamily", "Genus"]).select(
        "Subfamily", "Genus", "Accession", "row_no")


@query("enrich_by_genus_family", oracle("""with m as (select Accession, row_no, coalesce(Genus, 'Unknown') as Genus, coalesce(Family, 'Unknown') as Family from v_meta),
    g as (select * from (select *, row_number() over (partition by Genus order by row_no) as rn from v_taxonomy where Genus is not null) where rn = 1),
    f as (select * from (select *, row_number() over (partition by Family order by row_no) as rn from v_taxonomy where Family is not null) where rn = 1)
    select m.Accession, m.row_no, m.Genus, coalesce(g.Family, m.Family) as Family, g.Class, g.Subfamily from m left join g on g.Genus = m.Genus
    where not (m.Family <> 'Unknown' and m.Genus = 'Unknown')
    union all select m.Accession, m.row_no, m.Genus, m.Family, f.Class, f.Subfamily from m left join f on f.Family = m.Family
    where m.Family <> 'Unknown' and m.Genus = 'Unknown'""", "v_meta", "v_taxonomy"))
def _(spark, d):
    meta = spark_view(spark, d, "v_meta").select("Accession", "row_no", "Genus", "Family")
    return T.enrich_by_genus_family(meta, spark_view(spark, d, "v_taxonomy"))


def fill_sql(meta: str, fallback: tuple[str, str] | None) -> str:
    """CTEs ending in filled: one scalar-map join per (key, target)."""
    ctes = [f"tx as materialized (select {', '.join(f'{clean(r)} as {r}' for r in RANKS)}, row_no from v_taxonomy)",
            f"m0 as (select Accession, Assembly, row_no, cast(null as varchar) as Class, {clean('Family')} as Family, "
            f"cast(null as varchar) as Subfamily, {clean('Genus')} as Genus, {clean('Species')} as Species from {meta})"]
    prev, n = "m0", 0
    for key in ("Species", "Genus", "Family"):
        targets = [r for r in RANKS[:RANKS.index(key)]]
        maps, cols = [], []
        for t in targets:
            n += 1
            ctes.append(f"map{n} as materialized (select {key} as k, min_by({t}, row_no) as v from tx "
                        f"where {key} is not null and {t} is not null group by {key})")
            maps.append(f"left join map{n} on map{n}.k = p.{key}")
            cols.append(f"coalesce(p.{t}, map{n}.v) as {t}")
        kept = [f"p.{r}" for r in RANKS if r not in targets]
        ctes.append(f"m_{key} as (select p.Accession, p.Assembly, p.row_no, {', '.join(cols + kept)} from {prev} p {' '.join(maps)})")
        prev = f"m_{key}"
    if fallback:
        level, taxon = fallback
        ctes.append(f"ref as (select * from tx where {level} = '{taxon}' order by row_no limit 1)")
        fill = RANKS[:RANKS.index(level) + 1]
        cols = [f"coalesce({r}, (select {r} from ref)) as {r}" if r in fill else r for r in RANKS]
        ctes.append(f"m_fb as (select Accession, Assembly, row_no, {', '.join(cols)} from {prev})")
        prev = "m_fb"
    ctes.append(f"filled as (select Accession, Assembly, row_no, {', '.join(f'''coalesce({r}, 'Unknown') as {r}''' for r in RANKS)} from {prev})")
    return ", ".join(ctes)


@query("hierarchical_fill", oracle(f"with {fill_sql('v_meta', None)} select * from filled", "v_meta", "v_taxonomy"))
def _(spark, d):
    return T.hierarchical_fill(spark_view(spark, d, "v_meta"), spark_view(spark, d, "v_taxonomy"), RANKS)


@query("lineage_fallback", oracle(f"with {fill_sql('v_meta', FALLBACK)} select * from filled", "v_meta", "v_taxonomy"))
def _(spark, d):
    return T.hierarchical_fill(spark_view(spark, d, "v_meta"), spark_view(spark, d, "v_taxonomy"), RANKS, fallback=FALLBACK)


CLASS_SQL = """fam as (select Family as k, max_by(Class, row_no) as v from v_taxonomy group by 1),
    gen as (select Genus as k, max_by(Class, row_no) as v from v_taxonomy group by 1),
    spc as (select Species as k, max_by(Class, row_no) as v from v_taxonomy group by 1),
    classed as (select m.*, coalesce(fam.v, gen.v, spc.v) as Class from v_meta m left join fam on fam.k = m.Family
    left join gen on gen.k = m.Genus left join spc on spc.k = m.Species)"""


@query("class_by_any_rank", oracle(f"with {CLASS_SQL} select Accession, coalesce(Class, 'Unknown') as Class from classed",
                                   "v_meta", "v_taxonomy"))
def _(spark, d):
    return T.class_by_any_rank(spark_view(spark, d, "v_meta"), spark_view(spark, d, "v_taxonomy")).select("Accession", "Class")


@query("assembly_to_accession", oracle("""select s.s_suppkey, s.Assembly, v_taxa.Accession from (select s_suppkey,
    concat('A', s_suppkey * 7) as Assembly from supplier) s left join v_taxa using (Assembly)""", "v_taxa"))
def _(spark, d):
    assemblies = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("A"), F.col("s_suppkey") * 7).alias("Assembly"))
    return T.assembly_to_accession(assemblies, spark_view(spark, d, "v_taxa").select("Assembly", "Accession")).select(
        "s_suppkey", "Assembly", "Accession")


HEAD_SQL = """picked as (select Accession, Assembly, Class, Genus, row_no from (select *, row_number() over (partition by Class order by row_no) as rn
    from classed where Class is not null) where rn <= 50
    union all select Accession, Assembly, Class, Genus, row_no from (select * from (select *, row_number() over (partition by Genus order by row_no) as rn
    from classed where Class is null and Genus is not null) where rn = 1 order by row_no limit 50))"""


@query("head_n_per_group", oracle(f"with {CLASS_SQL}, {HEAD_SQL} select Accession, Class, Genus from picked", "v_meta", "v_taxonomy"))
def _(spark, d):
    classed = T.class_by_any_rank(spark_view(spark, d, "v_meta"), spark_view(spark, d, "v_taxonomy"), unknown=None)
    return T.head_n_per_group(classed).select("Accession", "Class", "Genus")


@query("concat_by_group", oracle("""with s as (select v_seq.*, split_part(id, '.', 1) as base from v_seq),
    m as (select row_no as n, concat('D', row_no) as base, case when row_no % 10 = 9 then null else
    concat('A', cast(floor(row_no / 3) as bigint)) end as asm from v_seq),
    p as (select m.n, id, seq, asm, coalesce('A|' || asm, 'R|' || base) as grp from m join s using (base)),
    h as (select grp, min_by(id, n) as id, max(asm) as assembly, count(*) as n_parts from p group by grp),
    b as (select *, coalesce(sum(length(seq)) over (partition by grp order by n rows between unbounded preceding and 1 preceding), 0) as before from p)
    select h.id, assembly, n_parts, cast(floor(before / 500) as bigint) as piece, string_agg(seq, '' order by n) as seq
    from b join h using (grp) group by grp, h.id, assembly, n_parts, cast(floor(before / 500) as bigint)""", "v_seq"))
def _(spark, d):
    seqs = spark_view(spark, d, "v_seq")
    assembly = F.when(F.col("row_no") % 10 == 9, "NA").otherwise(F.concat(F.lit("A"), F.floor(F.col("row_no") / 3)))
    meta = seqs.select(F.concat(F.lit("D"), "row_no").alias("Accession"), "row_no", assembly.alias("Assembly"))
    return T.concat_by_group(meta, seqs, piece_chars=500).select("id", "assembly", "n_parts", "piece", "seq")


@query("merge_datasets", oracle("""with m as (select Accession, Family, Genus, row_no from (select *, row_number() over (partition by Accession order by part, row_no) as rn from (
    select split_part(Accession, '.', 1) as Accession, Family, Genus, 1 as part, row_no from v_taxa union all
    select split_part(Accession, '.', 1), Family, Genus, 2, 0 from v_pred)
    where Accession in (select concat('C', row_no) from v_seq union select concat('C', l_suppkey) from lineitem)) where rn = 1),
    s as (select base, id, seq from (select *, row_number() over (partition by base order by part, row_no) as rn from (
    select concat('C', row_no) as base, concat('C', row_no, '.1') as id, seq, 1 as part, row_no from v_seq union all
    select concat('C', l_suppkey), concat('C', l_suppkey, '.7'), l_returnflag, 2, l_orderkey * 10 + l_linenumber from lineitem)) where rn = 1)
    select id, seq, Accession, Family, Genus, row_no from s left join m on Accession = base""",
    "v_taxa", "v_pred", "v_seq"))
def _(spark, d):
    taxa = spark_view(spark, d, "v_taxa").withColumn("Accession", F.split_part("Accession", F.lit("."), F.lit(1)))
    pred = spark_view(spark, d, "v_pred").withColumn("Accession", F.split_part("Accession", F.lit("."), F.lit(1)))
    docs = spark_view(spark, d, "v_seq").select(F.concat(F.lit("C"), "row_no", F.lit(".1")).alias("id"), "seq", "row_no")
    items = table(spark, d, "lineitem").select(F.concat(F.lit("C"), "l_suppkey", F.lit(".7")).alias("id"),
                                               F.col("l_returnflag").alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    seqs, meta = T.merge_datasets(docs, taxa, items, pred.withColumn("row_no", F.lit(0).cast("bigint")))
    return seqs.join(meta, strip_version("id") == F.col("Accession"), "left").select("id", "seq", "Accession", "Family", "Genus", "row_no")


@query("value_counts", oracle("select Genus, count(*) as n from v_taxa group by Genus", "v_taxa"))
def _(spark, d):
    return M.value_counts(spark_view(spark, d, "v_taxa"), "Genus")


# --- relationship bounds -------------------------------------------------------------------

LINEAGE = ("Family", "Subfamily", "Genus")


def bounds_sql(pairs: str, meta: str = "v_taxa", node: str = "Accession") -> str:
    """CTE bounds(source, target, lower, upper): closed form by the first known difference."""
    known = ", ".join(f"case when {r} not in ('Unknown', '') then {r} end as r{n}" for n, r in enumerate(LINEAGE, 1))
    return f"""kn as materialized (select {node} as node, {known} from {meta}),
    cmp as (select source, target, case when l.r1 <> r.r1 then 1 when l.r2 <> r.r2 then 2 when l.r3 <> r.r3 then 3 else 4 end as m,
    l.r1 is not null and r.r1 is not null as b1, l.r2 is not null and r.r2 is not null as b2, l.r3 is not null and r.r3 is not null as b3
    from {pairs} join kn l on l.node = source join kn r on r.node = target),
    bounds as materialized (select source, target, case when b3 and m > 3 then 3 when b2 and m > 2 then 2 when b1 and m > 1 then 1 else 0 end as lower, m - 1 as upper from cmp)"""


@query("relationship_bounds", oracle(f"with {bounds_sql('v_edges')} select source, target, lower, upper, count(*) as n from bounds group by all",
                                     "v_edges", "v_taxa"))
def _(spark, d):
    out = T.relationship_bounds(spark_view(spark, d, "v_edges"), spark_view(spark, d, "v_taxa"), LINEAGE)
    return out.groupBy("source", "target", "lower", "upper").agg(F.count("*").alias("n"))


PAIR_SQL = "pr as (select distinct least(source, target) as source, greatest(source, target) as target from v_edges where source <> target)"


@query("weights_vs_bounds", oracle(f"""with {PAIR_SQL}, {bounds_sql('pr')} select source, target, lower, upper, weight from bounds
    join v_edges using (source, target)""", "v_edges", "v_taxa"))
def _(spark, d):
    return _points(spark, d)


def _points(spark, d):
    from kinweave.functions.columns import pair_high, pair_low
    edges = spark_view(spark, d, "v_edges")
    pairs = edges.where("source <> target").select(
        pair_low("source", "target").alias("source"), pair_high("source", "target").alias("target")).distinct()
    bounds = T.relationship_bounds(pairs, spark_view(spark, d, "v_taxa"), LINEAGE)
    return M.weights_vs_bounds(bounds, edges)


@query("trend_fit", oracle(f"""with {PAIR_SQL}, {bounds_sql('pr')}, p as (select lower, upper, weight from bounds join v_edges using (source, target))
    select 'lower' as bound, round(regr_slope(weight, lower), 6) as slope, round(regr_intercept(weight, lower), 6) as intercept, round(corr(lower, weight), 6) as r from p
    union all select 'upper', round(regr_slope(weight, upper), 6), round(regr_intercept(weight, upper), 6), round(corr(upper, weight), 6) from p""",
    "v_edges", "v_taxa"))
def _(spark, d):
    out = M.trend_fit(_points(spark, d))
    return out.select("bound", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")])


@query("prepare_reference_set", oracle(f"""with {CLASS_SQL}, {HEAD_SQL.replace('<= 20', '<= 50').replace('limit 20', 'limit 50')},
    firsts as (select * from (select *, row_number() over (partition by case when Assembly in ('', 'NA', 'na', 'None', 'none') or Assembly is null
    then 'R|' || Accession else 'A|' || Assembly end order by row_no) as rn from v_meta) where rn = 1), {fill_sql('firsts', FALLBACK)},
    ch as (select picked.Assembly, v_taxa.Accession, coalesce(Class, 'Unknown') as chosen_class from picked left join v_taxa using (Assembly))
    select ch.Assembly, ch.Accession, chosen_class, f.Class, f.Family, f.Subfamily, f.Genus, f.Species, count(*) as n
    from ch join filled f using (Assembly) group by all""", "v_meta", "v_taxonomy", "v_taxa"))
def _(spark, d):
    out = prepare_reference_set(spark_view(spark, d, "v_meta"), spark_view(spark, d, "v_taxonomy"),
                                spark_view(spark, d, "v_taxa").select("Assembly", "Accession"), RANKS, FALLBACK)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))
