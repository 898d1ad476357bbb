"""Language by cross-parsing: a text is cut into the longest phrases that occur in a language's labelled text.

A suffix automaton of the labelled text accepts exactly its substrings.  A text is read byte by byte; where the automaton
of a language has no way on, a phrase ends and the next one begins with that byte.  The fewer phrases, the lower the
cross-entropy estimate  phrases * log2(reference length) / text length, and the language of the least estimate wins.

The automata are turned into one dense table with the restart built in, so thousands of pieces of text in all
languages advance by one byte with one table look-up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kinweave.llm.words import bounded, sub_batches

#: Distinct texts per language that a model is made of (those of least hash), and characters that each gives, from a place
#: that its hash chooses.  Many short excerpts keep a repeated passage or a text in two languages from standing for its language.
SAMPLE_ROWS = 96
SAMPLE_CHARS = 256
#: A text is read in pieces of so many bytes, all of them, and phrases go on from piece to piece.
PIECE = 2048
#: Pieces read at a time: bounds a task's memory for a batch of any size.
LANES = 4096
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    references: list[bytes]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts the substrings of ``text``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """All languages' automata in one table: entry [state, symbol] is 2 * next state + (1 if a phrase ends here)."""

    def __init__(self, references: list[bytes]):
        self.symbol = np.zeros(256, np.int32)
        known = sorted(set(b"".join(references)))
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.width = width = len(known) + 1
        tables, self.roots, offset = [], [], 0
        for text in references:
            automaton = suffix_automaton(text)
            # one state more: the last byte occurs nowhere in the reference and is a phrase of its own
            alone = len(automaton)
            table = np.full((alone + 1, width), -1, np.int64)
            for s, ways in enumerate(automaton):
                if ways:
                    table[s, self.symbol[list(ways)]] = list(ways.values())
            first = np.where(table[0] >= 0, table[0], alone)
            ended = table < 0
            table = np.where(ended, first[None, :], table)
            ended[0] = False  # the start is no phrase's end
            tables.append((table + offset) * width * 2 + ended)
            self.roots.append(offset * width)
            offset += alone + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        kind = np.int32 if 2 * self.table.size < 1 << 31 else np.int64
        self.table, self.roots = self.table.astype(kind), np.array(self.roots, kind)

    def phrases(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); an open phrase at a text's end counts as one."""
        pieces = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[row] + nth * PIECE
        size = np.minimum(PIECE, starts[row] + sizes[row] - begin)
        count, place = np.zeros((len(row), len(self.roots)), np.int64), np.zeros((len(row), len(self.roots)), self.table.dtype)
        for at in range(0, len(row), LANES):
            some = slice(at, at + LANES)
            # a piece whose predecessor lies in the lanes before goes on from where that ended
            before = place[at - 1] if at and nth[at] else None
            count[some], place[some] = self._read(raw, begin[some], size[some], nth[some], before)
        out = np.zeros((len(sizes), len(self.roots)), np.int64)
        np.add.at(out, row, count)
        return out + (sizes > 0)[:, None]

    def _steps(self, raw, begin, size, place):
        """Read pieces side by side from given places: per byte the pieces still read (longest first) and where phrases end before it."""
        live = len(begin)
        for i in range(int(size[0]) if live else 0):
            while size[live - 1] <= i:
                live -= 1
            went = self.table[place[:live] + self.symbol[raw[begin[:live] + i]][:, None]]
            place[:live] = went >> 1
            yield i, live, (went & 1).astype(bool)

    def _read(self, raw, begin, size, nth, before):
        """(phrase ends, last place) of pieces that follow one another in their texts (``nth`` counts them).

        All pieces are first read from the start of a phrase.  Then each is read again from where its predecessor ended, until
        a phrase ends where one of the first reading does; from there on both go the same way.  Only where that does
        not happen within the piece is its end another one, and its successor is read once more.
        """
        order = np.argsort(-size, kind="stable")
        ends = np.zeros((len(begin), len(self.roots), int(size.max(initial=0))), bool)
        place = np.repeat(self.roots[None, :], len(begin), axis=0)
        for i, live, ended in self._steps(raw, begin[order], size[order], place):
            ends[:live, :, i] = ended
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ends, last = ends[back], place[back]
        fresh = ends.sum(axis=2)
        count = fresh.copy()
        ends[:, :, :1] = True  # the first reading began a phrase there
        first_last = last.copy()
        again = np.flatnonzero((nth > 0) & ((np.arange(len(nth)) > 0) | (before is not None)))
        while len(again):
            again = again[np.argsort(-size[again], kind="stable")]
            place = np.where((again > 0)[:, None], last[again - 1], before if before is not None else 0).astype(self.table.dtype)
            seen, passed = np.zeros(place.shape, np.int64), np.zeros(place.shape, np.int64)
            met, total = np.zeros(place.shape, bool), np.zeros(place.shape, np.int64)
            for i, live, ended in self._steps(raw, begin[again], size[again], place):
                here = ends[again[:live], :, i]
                seen[:live] += ended
                passed[:live] += here
                new = ended & here & ~met[:live]
                total[:live][new] = (seen[:live] + fresh[again[:live]] + 1 - passed[:live])[new]
                met[:live] |= new
                if met.all():
                    break
            count[again] = np.where(met, total, seen)
            end = np.where(met, first_last[again], place)
            changed = again[(end != last[again]).any(axis=1)]
            last[again] = end
            follows = changed + 1
            again = follows[(follows < len(nth))]
            again = again[nth[again] > 0]
        return count, last


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Keep an excerpt of ``sample_chars`` characters of each of the ``sample_rows`` labelled texts of least hash.

    Equal texts of a language count once.  The excerpt begins at a place that the text's hash chooses, anywhere in the text.
    Rows without a language or without text are not used.  At most languages * rows * characters come to the driver.
    Without labelled rows the model has no language.
    """
    hashed = F.xxhash64(F.lit("text"), F.col(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), hashed.alias("h"), F.col(text_col).alias("_text"))
    # sample_rows hashes per language: as bounded as the model that is made of them
    distinct = rows.groupBy("lang", "h").agg(F.count("*").alias("copies"))
    best = distinct.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_rows).drop("copies")
    room = F.greatest(F.length("_text") - sample_chars, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64(F.lit("place"), F.col("_text")), room.cast("bigint")) + 1).cast("int")
    picked = rows.join(F.broadcast(best), ["lang", "h"]).groupBy("lang", "n").agg(F.min(F.lower(F.substring(F.col("_text"), place, F.lit(sample_chars)))).alias("t"))
    found: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.n)):
        found.setdefault(r.lang, []).append(r.t.encode())
    return Model(sorted(found), [b"\n".join(found[k]) for k in sorted(found)])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole text; no shuffle.

    ``und`` with score 0 if the text is null or has no letter, or the model has no language.  The score is the share
    of the other languages' least phrase estimate in the sum of both (1 with one language): 1/2 is a draw, and ties go
    to the language that sorts first.  Other columns (or those in ``keep``) pass through; those called lang_pred or
    score are replaced.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = StructType([*[docs.schema[c] for c in rest], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, parser = sent.value, None
        weight = np.log2(np.array([max(2, len(r)) for r in m.references], float))
        for batch in (part for whole in batches for part in sub_batches(whole, len(rest), 1 << 25)):
            parser = parser or Parser(m.references)
            texts = batch.column(len(rest)).cast(pa.large_string())
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            size = np.diff(edges)
            total = parser.phrases(raw, edges[:-1], size) if m.languages else np.zeros((len(size), 0))
            estimate = total * weight[None, :] / np.maximum(1, size)[:, None]
            labels, scores = [], []
            for k in range(len(size)):
                if not size[k] or not m.languages:
                    labels.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmin(estimate[k]))
                others = np.delete(estimate[k], best)
                labels.append(m.languages[best])
                scores.append(float(others.min() / (others.min() + estimate[k, best])) if len(others) else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    # a text without a letter goes as an empty one
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(F.col(text_col))).otherwise(F.lit(""))
    return bounded(docs).select(*[F.col(f"`{c}`") for c in rest], lettered.alias("_lettered")).mapInArrow(run, schema)
