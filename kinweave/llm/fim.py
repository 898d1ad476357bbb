"""Fill-in-middle documents as a pipeline of Arrow kernels.

A batch of texts becomes list arrays of units (lines with their newline).  The lists are flattened with their parent
indices, a unit's ordinal is its place behind its parent's offset, and two cuts per text give every unit a role.  Each
role's units are filtered out and put back into lists, and one join per role gives prefix, middle and suffix.  No step
loops over documents.  Rows stay where they are: there is no shuffle, and a task holds one part of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinweave.llm.words import bounded, sub_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
                   StructField("middle_chars", LongType()), StructField("output", StringType())])


def draws(seed: int, id_col: str) -> Column:
    """Four numbers below 2 ** 32 for a document; they depend on the seed and its id only.  A null id is drawn as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of all texts behind one another, the parent of each, and the number of units per text; texts without null."""
    lists = pc.split_pattern(texts, "\n")
    length = pc.list_value_length(lists).to_numpy()
    pieces, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    offset = np.cumsum(length) - length
    last = np.arange(len(parent)) - offset[parent] == length[parent] - 1
    # every piece but a text's last ended in a newline; a last piece without characters is no unit
    ended = pc.binary_join_element_wise(pieces, pc.if_else(pa.array(last), "", "\n"), "")
    kept = ~last | (pc.binary_length(pieces).to_numpy() > 0)
    return ended.filter(pa.array(kept)), parent[kept], np.bincount(parent[kept], minlength=len(texts))


def of_role(pieces: pa.Array, parent: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """The chosen units of every text, joined."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=rows))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pieces.filter(pa.array(chosen)))
    return pc.binary_join(lists, "")


def rearrange(texts: pa.Array, drawn: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array]:
    """The columns of ``MADE`` for a batch of texts without null; ``drawn`` has four numbers per text."""
    rows = len(texts)
    pieces, parent, n = units(texts)
    first, second = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
    before, after = ordinal < low[parent], ordinal >= high[parent]
    prefix, middle, suffix = (of_role(pieces, parent, chosen, rows) for chosen in (before, ~before & ~after, after))
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    plain = pc.or_(pc.or_(marked, pa.array(n == 0)), pa.array(drawn[:, 2] % 100 >= rate))
    swapped = pa.array(drawn[:, 3] % 100 < spm)
    as_spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    as_psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    none = pa.scalar(None, pa.int64())
    return {"n": pa.array(n, pa.int64()), "form": pc.if_else(plain, "plain", pc.if_else(swapped, "spm", "psm")),
            "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
            "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
            "output": pc.if_else(plain, texts, pc.if_else(swapped, as_spm, as_psm))}


def _cut(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind the first mark of every text; nothing stands behind where there is none."""
    halves = pc.split_pattern(texts, mark, max_splits=1)
    two = pc.equal(pc.list_value_length(halves), 2)
    return pc.list_element(halves, 0), pc.if_else(two, pc.list_element(pc.if_else(two, halves, pa.scalar(["", ""], halves.type)), 1), "")


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """Texts from outputs and forms.  No piece holds a mark, and no mark can begin within another, so the first mark found is the one written."""
    swapped, plain = pc.equal(form, "spm"), pc.equal(form, "plain")
    body = pc.utf8_slice_codeunits(output, len(PREFIX))
    head, rest = _cut(body, SUFFIX)
    suffix, middle = _cut(rest, MIDDLE)
    psm = pc.binary_join_element_wise(head, middle, suffix, "")
    head, rest = _cut(body, PREFIX)
    prefix, middle = _cut(rest, MIDDLE)
    spm = pc.binary_join_element_wise(prefix, middle, head, "")
    return pc.if_else(plain, output, pc.if_else(swapped, spm, psm))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text",
              restored: str | None = None) -> DataFrame:
    """Cut every whole text at two unit borders and write its parts in fill-in-middle order.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of these with the suffix first; which, and where they are
    cut, depends on ``seed`` and id only, so reruns agree and rows with the same id are cut by the same numbers.  Adds the
    columns of ``MADE``: number of units, form (plain, psm, spm), code points of prefix and middle (null if plain) and output.
    A null text is an empty one; empty texts and texts that hold a mark are plain.  Other columns pass through, the text
    included; those with a name of ``MADE`` are replaced.  ``restored`` names a column for the texts rebuilt from output and
    form.  An empty table gives an empty one.
    """
    made = [*MADE.fieldNames(), *([restored] if restored else [])]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    kept = [StructField(text_col, StringType())] if text_col not in made else []
    schema = StructType([*[docs.schema[c] for c in rest], *kept, *MADE, *([StructField(restored, StringType())] if restored else [])])
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sub_batches(whole, at)):
            texts = batch.column(at)
            drawn = pc.list_flatten(batch.column(at + 1)).to_numpy().reshape(len(texts), 4)
            columns = rearrange(texts, drawn, rate, spm)
            if restored:
                columns[restored] = rebuilt(columns["output"], columns["form"])
            front = [*batch.columns[:at], *([texts] if kept else [])]
            yield pa.RecordBatch.from_arrays([*front, *columns.values()], names=[*rest, *[f.name for f in kept], *made])

    # a name that no column has, whatever the table is called with
    numbers = "_" * (1 + max(len(c) for c in docs.columns)) + "draws"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return (bounded(docs).select(*[F.col(f"`{c}`") for c in rest], text.alias(text_col), draws(seed, f"`{id_col}`").alias(numbers))
            .mapInArrow(run, schema))


def restore(table: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """Add the texts that outputs and forms stand for; a column called ``out`` is replaced.  Null outputs or forms give null."""
    rest = [c for c in table.columns if c != out]
    schema = StructType([*[table.schema[c] for c in rest], StructField(out, StringType())])
    at, form_at = rest.index(output_col), rest.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sub_batches(whole, at)):
            yield pa.RecordBatch.from_arrays([*batch.columns, rebuilt(batch.column(at), batch.column(form_at))], names=[*rest, out])

    return bounded(table).select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
