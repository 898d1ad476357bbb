"""Views over the given tables, in SQL that Spark and the check engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_CLEAN = "replace(replace(lower(text), chr(10), ''), ' ', '')"

VIEWS = {
    "v_items": """select distinct concat('C', o_custkey) as query, concat('P', l_partkey) as target
        from {lineitem} join {orders} on o_orderkey = l_orderkey
        union select distinct concat('C', o_custkey), concat('T', p_type)
        from {lineitem} join {orders} on o_orderkey = l_orderkey join {part} on p_partkey = l_partkey""",
    "v_hits": """select concat('C', o_custkey, '.', 1 + l_linenumber % 2) as query, concat('P', l_partkey) as target,
        round(100 * (1 - l_discount), 2) as pident, cast(l_quantity + 10 * h as int) as alnlen,
        l_linenumber as mismatch, l_linenumber % 3 as numgapopen,
        cast(1 + (l_orderkey * 37 + h * 23) % 900 as int) as qstart,
        cast(1 + (l_orderkey * 37 + h * 23) % 900 + l_quantity + 10 * h as int) as qend,
        1 as tstart, cast(1 + l_quantity + 10 * h as int) as tend,
        cast(case (l_linenumber + h) % 4 when 0 then 1e-3 when 1 then 1e-6 when 2 then 1e-10 else 1e-30 end as double) as evalue,
        l_quantity * 2.5 + h * 20 as bitscore, 1000 as qlen, cast(500 + (l_partkey % 50) * 20 as int) as tlen
        from {lineitem} join {orders} on o_orderkey = l_orderkey
        cross join (select 0 as h union all select 1 as h union all select 2 as h) hsp""",
    "v_taxa": """select concat('C', c_custkey, '.1') as Accession,
        concat('A', cast(floor(c_custkey / 3) as bigint)) as Assembly,
        case when c_custkey % 13 = 0 then 'Unknown' else r_name end as Family,
        case when c_custkey % 7 = 0 then '' else n_name end as Subfamily,
        case when c_custkey % 5 = 0 then null else concat(n_name, '-', c_mktsegment) end as Genus, c_custkey as row_no
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_taxonomy": """select concat('Class', (r_regionkey + c_custkey % 3) % 2) as Class,
        case when c_custkey % 17 = 0 then 'Unknown' else r_name end as Family,
        case when c_custkey % 11 = 0 then null else n_name end as Subfamily,
        case when c_custkey % 19 = 0 then ' NA ' else concat(n_name, '-', c_mktsegment) end as Genus,
        concat('sp', c_custkey) as Species, c_custkey as row_no
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_meta": """select concat('C', c_custkey, '.1') as Accession,
        case when c_custkey % 10 = 9 then 'NA' else concat('A', cast(floor(c_custkey / 3) as bigint)) end as Assembly,
        case when c_custkey % 4 = 0 then concat(' SP', c_custkey, ' ') when c_custkey % 4 = 1 then 'unclassified' else null end as Species,
        case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'Unknown' else concat(n_name, '-', c_mktsegment) end as Genus,
        case when c_custkey % 13 = 0 then 'NA' when c_custkey % 13 = 1 then null else r_name end as Family, c_custkey as row_no
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_edges": """select concat('C', o_custkey, '.1') as source,
        concat('C', (o_custkey * 7 + o_orderkey) % (select count(*) from {customer}), '.1') as target,
        round(o_totalprice / 500000, 8) as weight from {orders}""",
    "v_pred": """select concat('C', c_custkey, '.2') as Accession, r_name as Family, n_name as Subfamily,
        case when c_custkey % 9 = 0 then 'Unclassified' else concat(n_name, '-', c_mktsegment) end as Genus
        from {customer} join {nation} on (c_nationkey + case when c_custkey % 4 = 0 then 1 else 0 end) % 25 = n_nationkey
        join {region} on n_regionkey = r_regionkey""",
    "v_seq": f"""select concat('D', doc_id, '.1') as id, lang as description, source as grp, doc_id as row_no,
        {_CLEAN} as seq from {{documents}}""",
    "v_bench": f"select concat('B', item_id) as id, {_CLEAN} as seq from {{benchmark}}",
    "v_bounds": """select concat('C', c_custkey) as source, cast(c_custkey % 4 as int) as lower,
        cast(least(3, c_custkey % 4 + c_custkey % 3) as int) as upper, cast((c_custkey * 5) % 4 as int) as pred
        from {customer}""",
    "v_gene_hits": """select distinct concat('G', l_partkey) as query,
        concat('D', l_orderkey % (select count(*) from {documents}), '.1') as target,
        cast(1 + (l_partkey * 37) % 40 as int) as qstart,
        cast(1 + (l_partkey * 37) % 40 + 20 + l_partkey % 10 as int) as qend,
        l_quantity * 2.5 + 20 as bitscore, l_orderkey, l_linenumber
        from {lineitem}""",
}


def spark_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(**{t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def oracle(body: str, *views: str) -> str:
    """SQL text with the named views as CTEs; ``body`` may start with its own WITH."""
    ctes = ", ".join(f"{v} as materialized ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views)
    body = body.strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{ctes + ', ' if ctes else ''}{body[len(start):]}"
    return f"with {ctes} {body}" if ctes else body
