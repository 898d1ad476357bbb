"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, chat, fim, itq, langid, licenses, lines, minhash, mixing, negatives, pii, topk, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % by


def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Key weights from the labels: good documents weigh 2, bad ones 1/2; others weigh 1."""
    return table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"), quality=quality(spark, folder))
    return found.select("doc_id", "size", "source_size", "target", "taken", "epochs")


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
q as (select doc_id, max(case quality when 1 then 2.0::double when 0 then 0.5::double end) as w from labels where doc_id is not null group by doc_id),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5.0::double, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as cap from s),
l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
f as (select *, (select level from l where level * weight <= cap order by cap / weight, source nulls last limit 1) as lv from l),
t as (select source, source_size, case when lv is null then cap else least(cap, lv * weight) end as target from f),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
k as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest, d.source,
    -ln((('0x' || substr(md5('mix|' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / coalesce(q.w, 1.0) as key
  from d left join q on d.doc_id = q.doc_id join e on d.source is not distinct from e.source),
b as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from k)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken, epochs from b
"""


def op2_rotate_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    found = chat.rotate(table(spark, folder, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("masks", masks)


OP2_SQL = """
with n as (
  select conv_id, floor(turn / 64)::bigint as part, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as said,
    row_number() over () as id from conversations),
r as (select *, ((row_number() over (partition by conv_id, part order by turn nulls last, speaker, said, id) - 1) // 64)::bigint as piece from n),
v as (select p.conv_id, p.part, p.piece, s.speaker as perspective from (select distinct conv_id, part, piece from r) p
      join (select distinct conv_id, speaker from r) s on p.conv_id is not distinct from s.conv_id),
x as (
  select v.conv_id, v.part, v.piece, v.perspective, r.turn, r.speaker, r.said, r.id, r.speaker = v.perspective as own,
    case when r.speaker = v.perspective then '<|assistant|>' else '<|user name=' || r.speaker || '|>' end as head, r.said || '<|end|>' as body
  from v join r on r.conv_id is not distinct from v.conv_id and r.part is not distinct from v.part and r.piece = v.piece),
o as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, part, piece, perspective order by turn nulls last, speaker, said, id
    rows between unbounded preceding and 1 preceding), 0)::bigint as pos from x)
select conv_id, perspective, part, piece, count(*) as n_turns, count(*) filter (own) as n_own, sum(length(head) + length(body) + 1)::bigint as n_chars,
  coalesce(string_agg((pos + length(head))::varchar || ':' || (pos + length(head) + length(body))::varchar, ',' order by pos) filter (own), '') as masks,
  string_agg(head || body || chr(10), '' order by pos) as text
from o group by conv_id, part, piece, perspective
"""


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op4_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP4_SQL = """
with e as (
  select vec_id, min([floor(256 * x::double)::bigint for x in embedding]) as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 group by vec_id),
s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]), 0)::bigint as score
      from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op5_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.score(docs.withColumn("held_out", remainder("doc_id", 3) == 1), model, keep=["doc_id", "held_out"])


def op6_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    return langid.predict(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model, keep=["doc_id", "held_out"])


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"))


def _op7_sql() -> str:
    import re

    rows = []
    for name, body in licenses.TEMPLATES.items():
        words = [w for w in re.split(r"[\W_]+", body.lower()) if w]
        rows += [f"('{name}', '{s}')" for s in sorted({" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))})]
    return rf"""
with t(name, shingle) as (values {', '.join(rows)}),
need as (select name, ceil(0.8 * count(*)) as need from t group by name),
d as (select row_number() over () as id, doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' as body from documents),
h as (select d.id, t.name, count(*) as hits from d join t on contains(d.body, ' ' || t.shingle || ' ') group by d.id, t.name),
f as (select h.id, string_agg(h.name, ',' order by h.name) as names, count(*) as n from h join need using (name) where h.hits >= need.need group by h.id)
select d.doc_id, coalesce(f.n, 0)::bigint as n_licenses, coalesce(f.names, '') as licenses from d left join f on d.id = f.id
"""


def op8_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle from (select doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (select i.a, i.b from i join n x on i.a = x.doc_id join n y on i.b = y.doc_id where 100 * common >= 85 * (x.n + y.n - common)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)
"""


def op9_quantised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_duplicates(table(spark, folder, "embeddings"))


OP9_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n using (vec_id)
"""


def tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids and their decoded bytes, with digests."""
    ranks = bpe.read_ranks(docs.sparkSession, vocabulary)
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return (both.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("bigint")).withColumn("ids_sha256", F.sha2("token_ids", 256))
            .withColumn("decoded_sha256", F.sha2("decoded", 256)))


def op10_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_line_index(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_repeated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
with d as (select row_number() over () as id, doc_id, string_split(coalesce(text, ''), chr(10)) as body from documents),
l as (select id, doc_id, unnest(body) as line, unnest(generate_series(1, len(body))) as line_no from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.*, r.first is not null and r.first <> k.doc_id as dropped from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not dropped), '')) as kept_sha256
from m group by id, doc_id
"""


def op12_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v, row_number() over () as uid
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.uid as anchor, a.vec_id as anchor_id, c.uid, c.vec_id, a.label = c.label as same, coalesce(list_sum([p[1] * p[2] for p in list_zip(a.v, c.v)]), 0)::bigint as score
      from e a join e c on a.uid <> c.uid and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select anchor, anchor_id, uid as positive, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor order by score desc, vec_id, uid) as r from s where same) where r <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.positive order by s.score desc, s.vec_id, s.uid) as rank
      from p join s on p.anchor = s.anchor and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.transform(table(spark, folder, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50, restored="restored")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP13_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') as u from documents),
h as (select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi from h),
p as (select *, array_to_string(u[1:lo], '') as prefix, array_to_string(u[lo + 1:hi], '') as middle, array_to_string(u[hi + 1:], '') as suffix,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_rotate_perspectives, op3_personal_data, op4_uniform_threshold, op5_toxicity_ftrl, op6_cross_parsing,
    op7_license_scan, op8_circulant_minhash, op9_quantised_vectors, op10_tree_bpe, op11_line_index, op12_tree_negatives, op13_fill_in_middle, pipeline)}

ORACLES = {"op1_mix_sources": OP1_SQL, "op2_rotate_perspectives": OP2_SQL, "op4_uniform_threshold": OP4_SQL, "op7_license_scan": _op7_sql(),
           "op8_circulant_minhash": OP8_SQL, "op9_quantised_vectors": OP9_SQL, "op11_line_index": OP11_SQL, "op12_tree_negatives": OP12_SQL,
           "op13_fill_in_middle": OP13_SQL}
