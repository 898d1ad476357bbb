"""Queries over readers, writers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.catalog import query
from kinweave.catalog.views import oracle, spark_view, table
from kinweave.functions import columns as C
from kinweave.operators import graph, neighbors, sharing, sketch, taxonomy
from kinweave.sources import readers, staging, writers

HIT_COLUMNS = [n for n, _ in readers.HIT_FIELDS_14]


def _written_hits(spark, d, names, label):
    path = staging.scratch_path(spark, label)
    hits = spark_view(spark, d, "v_hits").select(*names)
    writers.write_edges(hits, path, sep="\t", header=False)
    return path


@query("read_fasta", oracle("""select id, concat(id, ' ', description) as description, seq from v_seq""", "v_seq"))
def _(spark, d):
    path = staging.scratch_path(spark, "fasta")
    writers.write_fasta(spark_view(spark, d, "v_seq"), path)
    return readers.read_fasta(spark, path)


@query("write_fasta", oracle("""select split_part(id, '.', 1) as id, length(seq) as n, seq from v_bench""", "v_bench"))
def _(spark, d):
    path = staging.scratch_path(spark, "fasta")
    records = spark_view(spark, d, "v_bench")
    writers.write_fasta(records.unionByName(records), path)
    out = readers.read_fasta(spark, path, first_by_base_id=True)
    return out.select("id", F.length("seq").cast("bigint").alias("n"), "seq")


_HIT_SUMMARY = """select query, target, count(*) as n, round(sum(pident), 4) as pident, cast(sum(alnlen) as bigint) as alnlen,
    cast(sum(qstart + qend + tstart + tend + mismatch + numgapopen{extra}) as bigint) as ints,
    round(max(evalue), 12) as evalue, round(sum(bitscore), 4) as bitscore from v_hits group by query, target"""


def _hit_summary(hits, extra=()):
    ints = sum((F.col(c) for c in ("qend", "tstart", "tend", "mismatch", "numgapopen", *extra)), F.col("qstart"))
    return hits.groupBy("query", "target").agg(
        F.count("*").alias("n"), F.round(F.sum("pident"), 4).alias("pident"), F.sum("alnlen").alias("alnlen"),
        F.sum(ints).alias("ints"), F.round(F.max("evalue"), 12).alias("evalue"),
        F.round(F.sum("bitscore"), 4).alias("bitscore"))


@query("read_m8_12", oracle(_HIT_SUMMARY.format(extra=""), "v_hits"))
def _(spark, d):
    return _hit_summary(readers.read_m8_12(spark, _written_hits(spark, d, HIT_COLUMNS[:12], "m8")))


@query("read_m8_14", oracle(_HIT_SUMMARY.format(extra=" + qlen + tlen"), "v_hits"))
def _(spark, d):
    hits = readers.read_m8_14(spark, _written_hits(spark, d, HIT_COLUMNS, "m8"))
    return _hit_summary(hits, ("qlen", "tlen"))


@query("read_edge_list", oracle("select query, target, count(*) as n from v_hits group by query, target", "v_hits"))
def _(spark, d):
    path = _written_hits(spark, d, ["query", "target", "qstart", "qend"], "edges")
    return readers.read_edge_list(spark, path).groupBy("query", "target").agg(F.count("*").alias("n"))


@query("read_metadata", oracle("""select Accession, Assembly, Family, nullif(Subfamily, '') as Subfamily, Genus,
    cast(row_no as varchar) as row_no from v_taxa""", "v_taxa"))
def _(spark, d):
    path = staging.scratch_path(spark, "meta")
    writers.write_edges(spark_view(spark, d, "v_taxa"), path)
    return readers.read_metadata(spark, path)


@query("read_weighted_edges", oracle("select source, target, weight from v_edges", "v_edges"))
def _(spark, d):
    path = staging.scratch_path(spark, "edges")
    edges = spark_view(spark, d, "v_edges").withColumnsRenamed(
        {"source": "query", "target": "subject", "weight": "ANI"})
    writers.write_edges(edges, path, sep="\t")
    return readers.read_weighted_edges(spark, path)


@query("write_edges", oracle("select source, target, weight from v_edges", "v_edges"))
def _(spark, d):
    path = staging.scratch_path(spark, "edges")
    writers.write_edges(spark_view(spark, d, "v_edges"), path)
    return readers.read_weighted_edges(spark, path, sep=",")


@query("merge_record_folder", oracle("select min_by(seq, row_no) as seq, true as is_stem from v_seq group by grp", "v_seq"))
def _(spark, d):
    path = staging.scratch_path(spark, "folder")
    records = spark_view(spark, d, "v_seq").repartition("grp").sortWithinPartitions("grp", "row_no")
    writers.write_fasta(records, path, by="grp")
    # file names are Spark's own, and one task uses the same one in several folders: the id must be the stem of one of them
    stems = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("id"))
    merged = readers.merge_record_folder(spark, path, recursive=True)
    return merged.join(stems.distinct().withColumn("is_stem", F.lit(True)), "id", "left").select("seq", F.coalesce("is_stem", F.lit(False)).alias("is_stem"))


_LETTERS = [(-0.1, "A"), (0.0, "C"), (0.1, "G")]


def aligned_strings(spark, d):
    """Aligned texts from the vectors: four genes of 16 letters per vector."""
    def letter(x):
        out = F.when(x < _LETTERS[0][0], _LETTERS[0][1])
        for limit, name in _LETTERS[1:]:
            out = out.when(x < limit, name)
        return out.otherwise("T")

    text = F.array_join(F.transform("embedding", letter), "")
    return table(spark, d, "embeddings").select("vec_id", text.alias("text"), F.explode(
        F.sequence(F.lit(0), F.lit(3))).alias("gene")).select(
            "gene", F.col("vec_id").alias("id"), F.substr("text", F.col("gene") * 16 + 1, F.lit(16)).alias("seq"))


def aligned_pairs(spark, d):
    """Each vector with the ten that follow it, if of the same label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = e.select(F.col("vec_id").alias("a"), "label", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("h"))
    return near.withColumn("b", F.col("a") + F.col("h")).join(
        e.select(F.col("vec_id").alias("b"), F.col("label").alias("label_b")), "b").where(
            "label = label_b").select("a", "b")


ALIGNED_SQL = """al as (select g.gene, vec_id as id, substring(array_to_string(list_transform(embedding, lambda x:
    case when x < -0.1 then 'A' when x < 0.0 then 'C' when x < 0.1 then 'G' else 'T' end), ''), cast(g.gene * 16 + 1 as bigint), 16) as seq
    from embeddings cross join (select unnest(range(4)) as gene) g),
    near as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y
    on y.vec_id > x.vec_id and y.vec_id <= x.vec_id + 10 and x.label = y.label),
    dists as (select l.gene, l.id as a, r.id as b, 1.0 - (select sum((substring(l.seq, i, 1) = substring(r.seq, i, 1))::int)
    from range(1, 17) t(i)) / 16.0 as dist
    from near join al l on l.id = near.a join al r on r.id = near.b and r.gene = l.gene)"""


@query("aligned_identity_distance", oracle(f"""with {ALIGNED_SQL}
    select cast(gene as int) as gene, a, b, round(dist, 6) as dist from dists"""))
def _(spark, d):
    out = sketch.aligned_identity_distance(aligned_strings(spark, d), aligned_pairs(spark, d))
    return out.withColumn("dist", F.round("dist", 6))


@query("average_distance_matrices", oracle(f"""with {ALIGNED_SQL}
    select a, b, round(avg(dist), 6) as dist, round(least(greatest(1 - avg(dist), 0), 1), 6) as weight from dists group by a, b"""))
def _(spark, d):
    dist = sketch.aligned_identity_distance(aligned_strings(spark, d), aligned_pairs(spark, d))
    return sketch.average_distance_matrices(dist).withColumns(
        {"dist": F.round("dist", 6), "weight": F.round("weight", 6)})


_NATION_BRAND = """cells as (select concat('n', s_nationkey) as a, p_brand as b, round(avg(l_discount), 4) as dist
    from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1, 2)"""


def nation_brand_cells(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(
        table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("a"), F.col("p_brand").alias("b")).agg(
        F.round(F.avg("l_discount"), 4).alias("dist"))


@query("read_distance_matrix", oracle(f"with {_NATION_BRAND} select a, b, dist from cells"))
def _(spark, d):
    path = staging.scratch_path(spark, "matrix")
    writers.write_matrix(nation_brand_cells(spark, d), path, "a", "b", "dist")
    return readers.read_distance_matrix(spark, path)


@query("write_matrix", oracle("""select p_brand, count(*) filter (where l_returnflag = 'A') as "A",
    count(*) filter (where l_returnflag = 'N') as "N", count(*) filter (where l_returnflag = 'R') as "R"
    from lineitem join part on p_partkey = l_partkey group by p_brand"""))
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    cells = rows.groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"))
    path = staging.scratch_path(spark, "matrix")
    writers.write_matrix(cells, path, "p_brand", "l_returnflag", "n", fill=0)
    schema = "p_brand string, A bigint, N bigint, R bigint"
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@query("empty_input_guard", oracle("""select count(*) as n_hits, 0 as n_edges from v_hits where evalue > 1""", "v_hits"))
def _(spark, d):
    path = staging.scratch_path(spark, "empty")
    writers.write_edges(spark_view(spark, d, "v_hits").select(*HIT_COLUMNS[:12]).where("evalue > 1"), path, "\t", False)
    hits = readers.read_m8_12(spark, path)
    edges = sharing.hypergeom_edges(sharing.presence_absence(hits))
    return hits.agg(F.count("*").alias("n_hits")).withColumn("n_edges", edges.agg(F.count("*")).scalar().cast("int"))


@query("stage_if_absent", oracle("select source, target, weight from v_edges", "v_edges"))
def _(spark, d):
    path = staging.scratch_path(spark, "stage")
    staging.stage_if_absent(spark, path, lambda: spark_view(spark, d, "v_edges"))
    return staging.stage_if_absent(spark, path, lambda: spark_view(spark, d, "v_edges").where("false"))


# --- scalar functions ----------------------------------------------------------------------

@query("strip_version", oracle("""select split_part(source, '.', 1) as source, split_part(target, '.', 1) as target, weight
    from v_edges""", "v_edges"))
def _(spark, d):
    return graph.strip_edge_versions(spark_view(spark, d, "v_edges"))


@query("header_id", oracle("""select id, split_part(concat(id, ' ', description), ' ', 1) as head,
    split_part(text, ' ', 1) as word from v_seq join documents on row_no = doc_id""", "v_seq"))
def _(spark, d):
    rows = spark_view(spark, d, "v_seq").join(table(spark, d, "documents"), F.col("row_no") == F.col("doc_id"))
    return rows.select("id", C.header_id(F.concat_ws(" ", "id", "description")).alias("head"),
                       C.header_id("text").alias("word"))


@query("hit_threshold_filter", oracle("""select query, target, qstart, qend, evalue, bitscore from v_hits
    where evalue <= 1e-5 and bitscore >= 50""", "v_hits"))
def _(spark, d):
    from kinweave.operators.hits import hit_threshold_filter
    return hit_threshold_filter(spark_view(spark, d, "v_hits")).select(
        "query", "target", "qstart", "qend", "evalue", "bitscore")


_TOKENS = """x as (select row_no, case row_no % 9 when 0 then ' Unknown ' when 1 then 'unclassified' when 2 then 'NA'
    when 3 then 'None' when 4 then '' when 5 then 'nan' when 6 then null when 7 then 'Unknown' else Genus end as v from v_taxa)"""


@query("normalize_unknown", oracle(f"""with {_TOKENS} select row_no,
    case when v not in ('Unknown', '') then v end as relation,
    case when lower(trim(v)) not in ('', 'nan', 'na', 'unknown') then v end as reconcile,
    case when lower(trim(v)) not in ('', 'unknown', 'unclassified', 'none', '<na>', 'na', 'null', 'nan') then lower(trim(v)) end as enrich,
    case when trim(coalesce(v, '')) in ('', 'Unknown', 'unclassified', 'Unclassified') then 'Unclassified' else trim(v) end as label,
    case when v not in ('', 'NA', 'na', 'None', 'none') then v end as assembly from x""", "v_taxa"))
def _(spark, d):
    r = F.col("row_no") % 9
    v = (F.when(r == 0, " Unknown ").when(r == 1, "unclassified").when(r == 2, "NA").when(r == 3, "None").when(r == 4, "")
         .when(r == 5, "nan").when(r == 6, F.lit(None)).when(r == 7, "Unknown").otherwise(F.col("Genus")))
    return spark_view(spark, d, "v_taxa").select("row_no", v.alias("v")).select(
        "row_no", C.known_relation_rank("v").alias("relation"), C.known_reconcile_value("v").alias("reconcile"),
        C.known_enrich_value("v").alias("enrich"), C.label_or_unclassified("v").alias("label"),
        C.known_assembly("v").alias("assembly"))


@query("coerce_weight", oracle("""with x as (select c_custkey, case c_custkey % 4 when 0 then c_mktsegment when 1 then ''
    when 2 then null else cast(c_acctbal as varchar) end as v from customer)
    select c_custkey, try_cast(v as double) as weight, coalesce(try_cast(v as double), 0.0) as lookup from x"""))
def _(spark, d):
    r = F.col("c_custkey") % 4
    v = F.when(r == 0, F.col("c_mktsegment")).when(r == 1, "").when(r == 3, F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", C.to_weight(v).alias("weight"),
                                              C.to_weight(v, 0.0).alias("lookup"))


@query("drop_self_loops", oracle("select source, target, weight from v_edges where source <> target", "v_edges"))
def _(spark, d):
    return graph.drop_self_loops(spark_view(spark, d, "v_edges"))


@query("canonical_pair", oracle("""select source, target, weight, least(source, target) as u, greatest(source, target) as v
    from v_edges""", "v_edges"))
def _(spark, d):
    return graph.canonical_pair(spark_view(spark, d, "v_edges"))


@query("minmax_rescale", oracle("""select source, target, round((weight - (select min(weight) from v_edges))
    / ((select max(weight) from v_edges) - (select min(weight) from v_edges)), 6) as weight from v_edges""", "v_edges"))
def _(spark, d):
    return graph.minmax_rescale(spark_view(spark, d, "v_edges")).withColumn("weight", F.round("weight", 6))


@query("edge_threshold", oracle("select source, target, weight from v_edges where source < target and weight > 0.1", "v_edges"))
def _(spark, d):
    return graph.edge_threshold(spark_view(spark, d, "v_edges"), 0.1)


@query("rank_profile", oracle("""select code, level, count(*) filter (where v is not null) as known from (
    select 0 as code, 'NR' as level, null as v from v_taxa union all
    select 1, 'Family', case when Family not in ('Unknown', '') then Family end from v_taxa union all
    select 2, 'Subfamily', case when Subfamily not in ('Unknown', '') then Subfamily end from v_taxa union all
    select 3, 'Genus', case when Genus not in ('Unknown', '') then Genus end from v_taxa) group by code, level""", "v_taxa"))
def _(spark, d):
    from kinweave.plans.params import LEVELS
    profile = taxonomy.rank_profile(LEVELS)
    taxa = spark_view(spark, d, "v_taxa")
    counts = taxa.agg(*[F.count(C.known_relation_rank(r)).alias(r) for r in profile if r != "NR"])
    long = counts.unpivot([], [r for r in profile if r != "NR"], "level", "known")
    return taxonomy.rank_profile_table(spark, profile).join(long, "level", "left").select(
        "code", "level", F.coalesce("known", F.lit(0)).alias("known"))


@query("clip_class", oracle("""select source, case when upper >= 3 then 0 else upper end as upper,
    case when lower >= 2 then 0 else lower end as lower from v_bounds""", "v_bounds"))
def _(spark, d):
    return spark_view(spark, d, "v_bounds").select(
        "source", C.clip_class("upper", 3).alias("upper"), C.clip_class("lower", 2).alias("lower"))


_SLICE_HITS = """h as (select concat('G', l_partkey) as query, concat('D', l_orderkey % (select count(*) + 5 from documents), '.1') as target,
    cast(1 + (l_partkey * 37) % 900 as int) as qstart, cast(1 + (l_partkey * 37) % 900 + l_quantity as int) as qend from lineitem)"""


@query("sequence_slice", oracle(f"""with {_SLICE_HITS} select query, target, qstart, qend, substring(seq, qstart, qend - qstart + 1) as fragment,
    seq is not null as found, count(*) as n from h left join v_seq on id = target group by all""", "v_seq"))
def _(spark, d):
    docs = table(spark, d, "documents").agg(F.count("*") + 5).scalar()
    start = (1 + (F.col("l_partkey") * 37) % 900)
    hits = table(spark, d, "lineitem").select(
        F.concat(F.lit("G"), "l_partkey").alias("query"),
        F.concat(F.lit("D"), F.col("l_orderkey") % docs, F.lit(".1")).alias("target"),
        start.cast("int").alias("qstart"), (start + F.col("l_quantity")).cast("int").alias("qend"))
    out = sketch.sequence_slice(hits, spark_view(spark, d, "v_seq"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("min_occurrence_filter", oracle("""with i as (select target from v_items group by target having count(*) >= 30),
    k as (select v.* from v_items v join i using (target)), s as (select query from k group by query having count(*) >= 10)
    select k.query, k.target from k join s using (query)""", "v_items"))
def _(spark, d):
    return sharing.min_occurrence_filter(spark_view(spark, d, "v_items"), 30, 10)


@query("validate_unique_ids", oracle("""with r as (select split_part(query, '.', 1) as id from v_hits)
    select id, count(*) as n from r group by id having count(*) > 1""", "v_hits"))
def _(spark, d):
    return taxonomy.validate_unique_ids(spark_view(spark, d, "v_hits").select(C.strip_version("query").alias("id")))


@query("fused_split", oracle("""select vec_id, round(list_sum(list_transform(embedding[1:32], lambda x: x::double)), 6) as ani_sum,
    round(list_sum(list_transform(embedding[33:64], lambda x: x::double)), 6) as gene_sum, len(embedding[33:64]) as n from embeddings"""))
def _(spark, d):
    def total(a):
        return F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return table(spark, d, "embeddings").select(
        "vec_id", total(C.first_half("embedding", 32)).alias("ani_sum"),
        total(C.second_half("embedding", 32)).alias("gene_sum"),
        F.size(C.second_half("embedding", 32)).cast("bigint").alias("n"))


@query("fuse_embeddings", oracle("""with a as (select vec_id, embedding[1:32] as e from embeddings where label < 7),
    b as (select vec_id, embedding[33:64] as e from embeddings where label > 2),
    f as (select coalesce(a.vec_id, b.vec_id) as node, list_concat(coalesce(a.e, list_transform(range(32), lambda x: 0::float)),
    coalesce(b.e, list_transform(range(32), lambda x: 0::float))) as e from a full join b using (vec_id))
    select node, generate_subscripts(e, 1) - 1 as pos, round(unnest(e)::double, 6) as value from f"""))
def _(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("label < 7").select(F.col("vec_id").alias("node"), C.first_half("embedding", 32).alias("emb"))
    second = e.where("label > 2").select(F.col("vec_id").alias("node"), C.second_half("embedding", 32).alias("emb"))
    fused = neighbors.fuse_embeddings(first, second, 32)
    return fused.select("node", F.posexplode("emb").alias("pos", "value")).select(
        "node", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"))
