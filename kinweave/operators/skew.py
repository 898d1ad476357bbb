"""Ordinals, running totals and self-joins that hold when one key owns a third of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinweave.functions.rng import hash_order
from kinweave.sources.staging import materialize


def running_total(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str],
                  value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the group.

    ``bucket`` must grow with ``order``.  Each (group, bucket) is summed map-side;
    the sums give bucket offsets, and only the rows of one bucket are sorted
    together.  No task sees a whole hot group.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
            .join(offsets, keys)
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .drop("_bucket", "_value", "_local", "_offset"))


def with_ordinal(df: DataFrame, keys: Sequence[str], group: Sequence[str] = (), salt: str = "",
                 name: str = "ordinal", digits: int = 2) -> DataFrame:
    """Dense 0-based position of each row in a fixed shuffle of its group.

    The order is the MD5 text of the keys; its first ``digits`` hex digits split a
    group into 16 ** digits buckets.
    """
    rows = df.withColumn("_hash", hash_order(salt, *keys))
    return running_total(rows, group, F.substring("_hash", 1, digits), ["_hash", *keys],
                         F.lit(1).cast("bigint"), name).drop("_hash")


def nth_rows(df: DataFrame, keys: Sequence[str], group: Sequence[str], wanted: DataFrame, salt: str = "", digits: int = 3,
             hashed: str | None = None) -> DataFrame:
    """The rows that ``with_ordinal`` would give the wanted ordinals, without numbering the others.

    ``wanted`` holds the group and ``ordinal``, and comes back with the keys of its rows.  A histogram over the first
    ``digits`` hex digits of the hash says which bucket an ordinal lies in; only rows of such buckets are sorted.  A
    group's histogram has 16 ** digits entries at most, whatever the group holds.  ``hashed`` names a column that already
    holds ``hash_order(salt, *keys)``.
    """
    order = F.col(hashed) if hashed else hash_order(salt, *keys)
    rows = df.select(*group, *[k for k in keys if k not in group], order.alias("_hash")).withColumn("_bucket", F.substring("_hash", 1, digits))
    counts = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # buckets and ordinals of a group in one order: the last bucket that begins at or before an ordinal holds it
    marks = starts.select(*group, F.col("_offset").alias("ordinal"), F.lit(0).alias("_asks"), "_bucket", "_offset").unionByName(
        wanted.select(*group, "ordinal").distinct().withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy(*group).orderBy("ordinal", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (marks.withColumn("_bucket", F.last("_bucket", True).over(so_far)).withColumn("_offset", F.last("_offset", True).over(so_far))
              .where("_asks = 1").drop("_asks"))
    touched = rows.join(placed.select(*group, "_bucket", "_offset").distinct(), [*group, "_bucket"])
    local = Window.partitionBy(*group, "_bucket").orderBy("_hash", *keys)
    ranked = touched.withColumn("ordinal", F.col("_offset") + F.row_number().over(local) - 1).drop("_hash", "_bucket", "_offset")
    return wanted.join(ranked, [*group, "ordinal"])


def pairs_within(df: DataFrame, group: Sequence[str], id_col: str, carry: Sequence[str] = (),
                 block: int = 2048, freq: str | None = None) -> DataFrame:
    """Unordered id pairs sharing a group value: (group, i, j, carry_i, carry_j), i < j.

    A group's members are hashed into blocks of about ``block`` rows, and the join
    key is (group, low block, high block): one task pairs two blocks at most,
    however large the group is.  ``freq`` names a column that already holds the
    group's row count.
    """
    if freq is None:
        df = df.join(df.groupBy(*group).agg(F.count("*").alias("_freq")), list(group))
    rows = df.withColumn("_blocks", F.ceil(F.col(freq or "_freq") / F.lit(block)).cast("int")).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
    left = rows.select(*group, F.col("_b").alias("_lo"), F.explode(F.sequence("_b", F.col("_blocks") - 1)).alias("_hi"),
                       F.col(id_col).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in carry])
    right = rows.select(*group, F.col("_b").alias("_hi"), F.explode(F.sequence(F.lit(0), "_b")).alias("_lo"),
                        F.col(id_col).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in carry])
    met = left.join(right, [*group, "_lo", "_hi"]).where("_lo < _hi or _l < _r")
    forward = F.col("_l") < F.col("_r")
    out = [F.least("_l", "_r").alias("i"), F.greatest("_l", "_r").alias("j")]
    for c in carry:
        out.append(F.when(forward, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")).alias(f"{c}_i"))
        out.append(F.when(forward, F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{c}_j"))
    return met.select(*group, *out)


#: Members of a group that lie in one row, pairs that a task counts (on average), tasks at most.
MEMBERS, TASK_PAIRS, MAX_TASKS = 2048, 1 << 21, 8192
#: Ids and rows of a block of ids (on average), group numbers in one row of an id, cells and meetings of one count inside a task.
BLOCK_IDS, BLOCK_ROWS, ID_GROUPS, CELLS = 1024, 1 << 22, 1 << 16, 1 << 21


def pair_counts(df: DataFrame, group: str, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(i, j, c, carry_i, carry_j): in how many rows of equal groups two ids meet, i < j.

    No pair is shuffled.  Where groups are small, every group sends its members to the buckets of ids that hold some of
    them (``_by_lists``).  Where they are so large that this would copy more rows, ids are hashed into blocks and every
    block is sent once per other block (``_by_blocks``).  The sizes of the groups tell how many rows either way copies.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(id_col).isNotNull()).select(F.col(group).alias("_g"), F.struct(F.col(id_col).alias("id"), *carry).alias("_m"))
    sizes = materialize(rows.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_k", F.monotonically_increasing_id()), "groups")
    n = F.col("_n").cast("double")
    pairs, held = (x or 0 for x in sizes.agg(F.sum(n * (n - 1) / 2), F.sum(n)).first())
    parallel = df.sparkSession.sparkContext.defaultParallelism
    tasks = int(min(MAX_TASKS, max(parallel, pairs // TASK_PAIRS)))
    copied = sizes.agg(F.sum(n * F.least(n, F.lit(float(tasks))))).first()[0] or 0
    if copied > 4 * held * math.sqrt(2 * parallel):  # blocks copy less at best only if lists copy more than this
        ids = rows.join(sizes, "_g", "left_semi").agg(F.approx_count_distinct("_m.id")).first()[0]
        blocks = block_number(ids, held, pairs, parallel)
        if copied > held * (blocks + 1):
            return _by_blocks(rows, sizes, blocks, held, carry)
    return _by_lists(rows, sizes, tasks, carry)


def block_number(ids: int, rows: float, pairs: float, parallel: int) -> int:
    """Blocks of ids, so that all pairs of two blocks' ids, or their meetings, are few, blocks are small and every core has work."""
    bounded = min(math.ceil(ids / BLOCK_IDS), math.ceil(math.sqrt(pairs / TASK_PAIRS)))
    return max(1, bounded, math.ceil(rows / BLOCK_ROWS), min(ids, math.ceil(math.sqrt(2 * parallel))))


def _by_lists(rows: DataFrame, sizes: DataFrame, tasks: int, carry: Sequence[str]) -> DataFrame:
    """Ids are hashed into buckets; a group sends its list of members once to every bucket that holds some of them, and the
    pairs of an id are formed and counted where its bucket lies.  A list has about ``MEMBERS`` entries, however large the group is.
    """
    placed = rows.join(sizes.select("_g", F.ceil(F.col("_n") / MEMBERS).cast("int").alias("_blocks")), "_g")
    hashed = F.xxhash64("_m.id")
    lists = placed.groupBy("_g", F.pmod(F.shiftright(hashed, 20), F.col("_blocks")).cast("int").alias("_block")).agg(F.collect_list("_m").alias("_right"))
    ends = placed.groupBy("_g", "_blocks", F.pmod(hashed, F.lit(tasks)).cast("int").alias("_bucket")).agg(
        F.collect_list("_m").alias("_left"), F.min("_m.id").alias("_least"))
    ends = ends.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    later = F.filter("_right", lambda m: m["id"] > F.col("_least"))
    met = ends.join(lists, ["_g", "_block"]).select("_bucket", "_left", later.alias("_right")).where(F.size("_right") > 0).repartition(tasks, "_bucket")
    each = met.select("_bucket", F.explode("_left").alias("l"), "_right").select("_bucket", "l", F.explode("_right").alias("r")).where("l.id < r.id")
    keys = [F.col("l.id").alias("i"), F.col("r.id").alias("j")]
    for c in carry:
        keys += [F.col(f"l.{c}").alias(f"{c}_i"), F.col(f"r.{c}").alias(f"{c}_j")]
    return each.groupBy("_bucket", *keys).agg(F.count("*").alias("c")).drop("_bucket")


def _by_blocks(rows: DataFrame, sizes: DataFrame, blocks: int, held: float, carry: Sequence[str]) -> DataFrame:
    """Ids are hashed into blocks, an id comes as rows of the numbers of its groups, and the rows of every two blocks meet in one group."""
    slots = max(1, math.ceil(held / ID_GROUPS / max(1, blocks)))  # a row of an id stays short even if one id holds most rows of a block
    placed = rows.join(sizes.select("_g", "_k"), "_g")
    packed = placed.groupBy("_m", F.pmod(F.xxhash64("_k"), F.lit(slots)).alias("_slot")).agg(F.collect_list("_k").alias("groups")).select(
        F.pmod(F.xxhash64("_m.id"), F.lit(blocks)).cast("int").alias("_b"), "_m.*", "groups")
    packed = materialize(packed, "id-groups")
    kept = [c for c in packed.columns if c != "_b"]
    left = packed.select(F.col("_b").alias("_lo"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("_hi"), F.lit(0).alias("_side"), *kept)
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_lo"), F.col("_b").alias("_hi"), F.lit(1).alias("_side"), *kept)
    types = {f.name: f.dataType for f in packed.schema}
    out = StructType([StructField("i", types["id"]), StructField("j", types["id"]),
                      *[StructField(f"{c}_{end}", types[c]) for c in carry for end in "ij"], StructField("c", LongType())])
    return left.unionByName(right).groupBy("_lo", "_hi").applyInArrow(_meetings(list(carry)), out)


def _meetings(carry: list[str]):
    """Counts the meetings of the ids of two blocks."""
    def members(rows: pa.Table):
        """Distinct (id, carry) with the first row of each, and (member, group) of all rows, sorted by member."""
        code = np.zeros(rows.num_rows, np.int64)
        for c in ("id", *carry):
            column = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        _, first = np.unique(code, return_index=True)
        groups = rows["groups"].combine_chunks()
        who = np.repeat(code, groups.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(who, kind="stable")
        return rows.take(pa.array(first)), who[order], groups.flatten().to_numpy()[order]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        (l_rows, l_who, l_group), (r_rows, r_who, r_group) = (members(rows.filter(pc.equal(rows["_side"], side))) for side in (0, 1))
        ids = pa.chunked_array([*l_rows["id"].chunks, *r_rows["id"].chunks])
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
        l_rank, r_rank = rank[:l_rows.num_rows], rank[l_rows.num_rows:]
        found = list(_count(l_who, l_group, l_rows.num_rows, r_who, r_group, r_rows.num_rows))
        l, r, c = (np.concatenate([np.empty(0, np.int64), *[f[n] for f in found]]) for n in range(3))
        # ids of one block meet twice, each once as the smaller
        kept = l_rank[l] < r_rank[r] if key[0].as_py() == key[1].as_py() else l_rank[l] != r_rank[r]
        l, r, c = l[kept], r[kept], c[kept]
        forward = l_rank[l] < r_rank[r]

        def ends(name):
            both = pa.chunked_array([*l_rows[name].chunks, *r_rows[name].chunks]).combine_chunks()
            at = l, r + l_rows.num_rows
            return both.take(pa.array(np.where(forward, *at))), both.take(pa.array(np.where(forward, at[1], at[0])))

        columns = dict(zip(("i", "j"), ends("id"), strict=True))
        for name in carry:
            columns |= dict(zip((f"{name}_i", f"{name}_j"), ends(name), strict=True))
        return pa.table({**columns, "c": pa.array(c, pa.int64())})

    return run


def _count(l_who, l_group, n_left, r_who, r_group, n_right):
    """(left, right, meetings) of two blocks' members in slices of left members, which hold ``CELLS`` cells or meetings, or one member.

    Rows come as (member, group), those of the left sorted by member.  Groups that many members hold are counted by a
    product of tables, the others meeting by meeting.
    """
    shared = np.intersect1d(l_group, r_group)
    if not len(shared):
        return

    def numbered(who, group):
        at = np.minimum(np.searchsorted(shared, group), len(shared) - 1)
        held = shared[at] == group
        return who[held], at[held]

    (l_who, l_at), (r_who, r_at) = numbered(l_who, l_group), numbered(r_who, r_group)
    by_group = np.argsort(r_at, kind="stable")
    r_who, r_start = r_who[by_group], np.searchsorted(r_at[by_group], np.arange(len(shared) + 1))
    r_size = np.diff(r_start)
    meetings = np.cumsum(np.bincount(l_who, weights=r_size[l_at], minlength=n_left))
    dense = n_left * n_right <= 16 * meetings[-1]
    cost = np.arange(1, n_left + 1) * n_right if dense else meetings
    begin = 0
    while begin < n_left:
        done = cost[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(cost, done + CELLS, side="right")))
        a, b = np.searchsorted(l_who, (begin, end))
        who, at = l_who[a:b] - begin, l_at[a:b]
        if dense:
            count = np.zeros((end - begin, n_right))
            often = np.flatnonzero(np.bincount(at, minlength=len(shared)) * r_size * 200.0 > count.size)
            width = max(1, 4 * CELLS // (n_right + end - begin))
            for n in range(0, len(often), width):
                some = often[n:n + width]
                place = np.full(len(shared), -1)
                place[some] = np.arange(len(some))
                mine, theirs = np.zeros((end - begin, len(some))), np.zeros((len(some), n_right))
                held = place[at] >= 0
                np.add.at(mine, (who[held], place[at[held]]), 1)
                for g in some:
                    np.add.at(theirs[place[g]], r_who[r_start[g]:r_start[g + 1]], 1)
                count += mine @ theirs
            rare = np.ones(len(shared), bool)
            rare[often] = False
            who, at = who[rare[at]], at[rare[at]]
        sizes = r_size[at]
        ends = np.cumsum(sizes)
        steps = [0]  # rows whose meetings are formed at once
        while steps[-1] < len(at):
            before = ends[steps[-1] - 1] if steps[-1] else 0
            steps.append(max(steps[-1] + 1, int(np.searchsorted(ends, before + CELLS, side="right"))))
        keys = []
        for x, y in zip(steps, steps[1:], strict=False):
            total = int(sizes[x:y].sum())
            inside = np.arange(total) - np.repeat(np.cumsum(sizes[x:y]) - sizes[x:y], sizes[x:y])
            met = np.repeat(who[x:y], sizes[x:y]) * n_right + r_who[np.repeat(r_start[at[x:y]], sizes[x:y]) + inside]
            if dense:
                count += np.bincount(met, minlength=count.size).reshape(count.shape)
            else:
                keys.append(np.unique(met, return_counts=True))
        if dense:
            l, r = np.nonzero(count)
            yield l + begin, r, np.rint(count[l, r]).astype(np.int64)
        elif keys:
            key, back = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
            yield key // n_right + begin, key % n_right, np.bincount(back, weights=np.concatenate([n for _, n in keys])).astype(np.int64)
        begin = end


def matched(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int = 2048) -> DataFrame:
    """Equality join of two written tables on a key that may be hot on either side, or on both.

    Keys without a partner go first.  The rows of a key are hashed into blocks of about
    ``block`` rows on each side, and the join key is (key, left block, right block):
    one task meets two blocks at most, however many rows a key has.
    """
    sizes = (left.groupBy(key).agg(F.count("*").alias("_n")).join(right.groupBy(key).agg(F.count("*").alias("_m")), key)
             .select(key, F.ceil(F.col("_n") / block).cast("int").alias("_left"), F.ceil(F.col("_m") / block).cast("int").alias("_right")))

    def dealt(rows: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        block_of = F.pmod(F.xxhash64(id_col), F.col(own)).cast("int")
        return rows.join(sizes, key).select(*rows.columns, block_of.alias(f"{own}_b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_b"))

    met = dealt(left, left_id, "_left", "_right").join(dealt(right, right_id, "_right", "_left"), [key, "_left_b", "_right_b"])
    return met.drop("_left_b", "_right_b")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order`` and then by all columns.

    An aggregate, not a window: map-side combining leaves one row per key and
    task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.struct(*[o.alias(f"_o{n}") for n, o in enumerate(order)], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(best).alias("_best"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])
