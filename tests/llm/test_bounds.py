"""Pieces, excerpts, clashing columns: what holds where texts are long, keys are shared and names collide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import chat, langid, pii

FOLDER = "/root/testdata/sf0.001"


# --- cross-parsing over pieces -------------------------------------------------------------

def phrases(text, reference):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in reference:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("piece, lanes", [(2048, 4096), (16, 8), (5, 3), (1, 2)])
def test_phrases_go_on_over_pieces(monkeypatch, piece, lanes):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "LANES", lanes)
    rng = np.random.default_rng(8)
    references = [bytes(rng.choice(list(b"abc"), 60)), b"abcabcabcabcabcabcabcabcabcabcabc", b"the cat sat on the mat"]
    texts = [bytes(rng.choice(list(b"abcz"), n, p=[0.4, 0.3, 0.28, 0.02])) for n in rng.integers(0, 200, 40)] + [b"", b"abc" * 60, b"z", b"the cat sat on the mat" * 9]
    raw, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    got = langid.Parser(references).phrases(raw, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [[phrases(t, r) for r in references] for t in texts]


def test_excerpts_come_from_anywhere_and_copies_count_once(spark):
    long = [f"{'opening ' * 40}{i} " + " ".join(f"w{i}x{j}" for j in range(400)) for i in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(long)] + [(100 + i, long[0], "en") for i in range(500)] + [(999, None, "en"), (1000, "", "de"), (1001, "hallo", "de"), (1002, "x", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("h", F.lit(1)).withColumn("n", F.lit(2))
    model = langid.fit(table, sample_rows=20, sample_chars=50)
    assert model.languages == ["de", "en"] and model.references[0] == b"hallo"
    excerpts = model.references[1].split(b"\n")
    assert len(excerpts) == 20 and sum(b"opening" in e for e in excerpts) < 10 and all(len(e) == 50 for e in excerpts)
    assert langid.fit(table.repartition(7), sample_rows=20, sample_chars=50) == model


# --- perspectives --------------------------------------------------------------------------

def test_parts_without_turn_numbers_are_cut_into_pieces(spark):
    rows = [(None, None, f"s{i % 2}", f"text {i:03d}") for i in range(150)] + [(None, None, "s0", "again")] * 70 + [(1, 5, "a", f"{i}") for i in range(9)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6), width=8).collect()
    for conv, speakers, said in ((None, 2, [(r[2], r[3]) for r in rows[:220]]), (1, 1, [(r[2], r[3]) for r in rows[220:]])):
        mine = [r for r in found if r.conv_id == conv]
        pieces = -(-len(said) // 8)
        assert len(mine) == speakers * pieces and max(r.n_turns for r in mine) <= 8
        for speaker in {s for s, _ in said}:
            own = sorted((r for r in mine if r.perspective == speaker), key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(pieces))
            want = "".join((f"<|assistant|>{t}" if s == speaker else f"<|user name={s}|>{t}") + "<|end|>\n" for s, t in sorted(said))
            assert "".join(r.text for r in own) == want
            assert sum(r.n_own for r in own) == sum(s == speaker for s, _ in said)


# --- names ---------------------------------------------------------------------------------

CLASHING = ("base", "candidates", "base_spans", "spans", "score", "predicted", "row", "size", "taken", "_row", "_text", "n", "kept", "text_key")


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert set(CLASHING) < set(docs.columns), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        wrong = " or ".join(f"`{c}` <> concat('{c} of ', doc_id)" for c in CLASHING)
        assert docs.count() > 0 and docs.where(wrong).count() == 0, name


def test_redacted_texts_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.com now", 7, "s"), (2, None, 8, "t")], "doc_id int, text string, base int, spans string")
    assert sorted(tuple(r) for r in pii.redact(docs).select("doc_id", "text", "base", "spans").collect()) == [(1, "mail <EMAIL> now", 7, "s"), (2, None, 8, "t")]


# --- uniform threshold ---------------------------------------------------------------------

def test_only_sufficient_entries_are_collected(spark, monkeypatch):
    from kinweave.llm import topk

    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-40, 41, 16)]) for i in range(900)] + [(1000 + i, [30.0] * 16) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sizes, resolved = [], topk._resolved
    monkeypatch.setattr(topk, "_resolved", lambda pairs, *a: sizes.append(pairs.count()) or resolved(pairs, *a))
    monkeypatch.setattr(topk, "ROWS", 200)
    monkeypatch.setattr(topk, "QUERIES", 16)
    whole = topk.whole_vectors(table, scale=1)
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(whole, whole.where("vec_id % 20 = 0"), 5).collect()]
    v = np.array([r[1] for r in rows])
    want = []
    for n, (i, _) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-int(s), rows[m][0]) for m, s in enumerate(v @ v[n]) if m != n)[:5]
            want += [(i, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(found) == sorted(want)
    queries, classes = 46, 901
    assert len(sizes) == 2 and sizes[0] <= queries * 2 * 6 and sizes[1] < 0.2 * queries * classes


# --- near-duplicate vectors ----------------------------------------------------------------

@pytest.mark.parametrize("shared, many", [(0.0, False), (0.5, False), (0.8, False), (0.9, True)])
def test_recall_where_vectors_share_a_direction(spark, shared, many):
    from kinweave.llm import itq

    rng = np.random.default_rng(11)
    axis = np.zeros(64)
    axis[0] = 1.0

    def drawn(n):
        x = rng.normal(size=(n, 64))
        x[:, 0] = 0
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return np.sqrt(shared) * axis + np.sqrt(1 - shared) * x

    base = drawn(1500)
    r = rng.normal(size=(600, 64))
    r -= (r * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    t = rng.uniform(0.931, 0.95, (600, 1))
    x = np.concatenate([base, t * base[:600] + np.sqrt(1 - t * t) * r])
    near = np.triu(x @ x.T >= 0.93, 1)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in itq.near_duplicates(rows).collect()}
    want = near.sum(axis=1) + near.sum(axis=0)
    assert all(found[i] <= n for i, n in enumerate(want)) and sum(found.values()) >= 0.99 * want.sum() and near.sum() >= 600
    assert not many or near.sum() > 2000


def test_tables_grow_with_the_bits_that_differ():
    from kinweave.llm import itq

    rng = np.random.default_rng(12)
    x = itq._unit(rng.normal(size=(2000, 64)))
    far = itq._unit(x * 0.5 + np.eye(64)[0])
    assert itq.fit_tables(x, 8, 0.93)[2] < itq.fit_tables(far, 8, 0.93)[2]
    assert itq.fit_tables(x, 8, 0.93)[2] < itq.fit_tables(x, 12, 0.93)[2]
    assert itq.fit_tables(x, 24, 0.5)[2] == 0
