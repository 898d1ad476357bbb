"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinweave.llm import bpe, chat, components, itq, langid, licenses, minhash, mixing, pii, queries, topk, toxicity, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, size int, base int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall old trees near a quiet river "


def docs(spark, texts, ids=None, source="s"):
    rows = [(i if ids is None else ids[i], t, "en", source, 0, 0.5, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = [None, "", "   ", "one", PROSE * 4, PROSE * 4, PROSE * 3000, "é" * 500, "\x00\x01", "1234567 " * 30, PROSE * 4]


@pytest.fixture(scope="module")
def ranks():
    lines = open(public_tokenizers.path(queries.VOCABULARY), "rb").read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    texts = ["a b  c", "", None, "c\x0bA", "  ", "b"]
    hashes, at = words.WordHasher(words.white_space(), fold=True)(pa.array(texts))
    found = [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(f) for f in found] == [3, 0, 0, 2, 0, 1]
    assert found[0][2] == found[3][0] and found[0][0] == found[3][1] and found[0][1] == found[5][0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    labels = {r.node: r.label for r in components.component_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({labels[i] for i in range(41)}) == 1 and len({labels[i] for i in range(100, 140)}) == 1
    assert len(set(labels.values())) == 3 and labels[200] == labels[201]
    assert components.component_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_mixing(spark):
    found = mixing.mix(docs(spark, TEXTS)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
    total = sum(size.values())
    assert {r.doc_id: r["size"] for r in found} == size
    assert all(r.target == total * 1.5 and r.taken <= 2 * r["size"] for r in found)
    assert sum(r.taken for r in found) == math.floor(total * 1.5)
    again = mixing.mix(docs(spark, TEXTS)).collect()
    assert sorted(found) == sorted(again)
    assert mixing.mix(docs(spark, [])).count() == 0
    copies = mixing.mixed(docs(spark, TEXTS))
    assert copies.columns == docs(spark, []).columns
    assert {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()} == {r.doc_id: math.ceil(r.taken / r["size"]) for r in found if r.taken}


def test_targets_are_limited_and_reshared(spark):
    rows = [("a", 100), ("b", 10), ("c", 50), ("d", 1000), (None, 5), ("", 0)]
    found = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    assert found[""].weight == 5 and found["a"].weight == 2 and found[None].weight == 1
    assert sum(r.target for r in found.values()) == pytest.approx(1.5 * 1165)
    assert all(r.target <= 2 * r.source_size for r in found.values())
    free = [r.target / r.weight for r in found.values() if r.target < 2 * r.source_size]
    assert max(free) - min(free) < 1e-6 and all(r.target / r.weight <= max(free) + 1e-6 for r in found.values())


def test_mixing_prefers_quality(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    quality = spark.range(2000).select("id", F.when(F.col("id") % 4 < 2, 4.0).otherwise(0.25).alias("w"))
    found = mixing.mix(rows, quality=quality, share=0.5, weights=(1,)).toPandas()
    good = found.doc_id % 4 < 2
    assert found[good].taken.sum() > 4 * found[~good].taken.sum() and found.taken.sum() == 4000


def test_perspectives(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "hello", 9), (1, 1, "assistant", "hello", 9), (1, None, None, None, 9), (None, 0, "user", "x", 9), (1, 70, "user", "late", 9)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, perspective int")).collect()
    by = {(r.conv_id, r.perspective, r.part): r for r in found}
    r = by[(1, "assistant", 0)]
    assert r.text == "<|user name=user|>hi<|end|>\n<|assistant|>hello<|end|>\n<|assistant|>hello<|end|>\n" and r.n_turns == 3 and r.n_own == 2
    assert [r.text[m.start:m.end] for m in r.masks] == ["hello<|end|>"] * 2
    assert [r.text[m.start:m.end] for r in found for m in r.masks if r.perspective == "unknown"] == ["<|end|>"]
    assert len(found) == 10 and by[(1, "unknown", 1)].masks == []
    assert chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(3)
    alphabet = list("a@.-+ ()0123456789é\U0001F600") + [" 4111 1111 1111 1111 ", "x@y.zz", "1.2.3.4", "+1 (988) 555-2485", "4242424242424242", "..x@y.z", "001.2.03.255", "1.2.3.999"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)] + TEXTS + ["1" * 50_000, "a." * 40_000, "1-" * 40_000 + "1", "+" + "1 " * 40_000, "a@" + "b." * 40_000 + "c"]
    found = pii.find(docs(spark, texts)).select("doc_id", "base_spans", "spans").collect()
    for r in found:
        want = base_spans(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base_spans] == want, repr(texts[r.doc_id][:200])
        assert set(want) <= {tuple(s) for s in r.spans}
        order = [(pii.KINDS.index(s.kind), s.start) for s in r.spans]
        assert order == sorted(order)
    assert pii.find(docs(spark, [])).count() == 0


def test_classifier_adds_what_its_labelers_agree_on(spark):
    good = [f"please call my phone (2{i:02d}) 555-{1000 + i} today" for i in range(60)]
    bad = [f"order no 1{i:02d}-555-{1000 + i}/x page" for i in range(60)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs(spark, good + bad)).collect()}
    assert all(found[i] == [("phone", 21 - 5 + 1, 31)] or found[i] for i in range(60))
    assert all(not found[i] for i in range(60, 120))


def test_redaction(spark):
    texts = ["mail a.b@c.de now", None, "ip 1.2.3.4 and +1 (988) 555-2485.", "plain"]
    found = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert found == {0: "mail <EMAIL> now", 1: None, 2: "ip <IP> and <PHONE>.", 3: "plain"}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.5]), (306, [0.25]), (None, [1.0] * 6), (5, rows[5][1]), (400, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    whole = topk.whole_vectors(table)
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(whole, whole.where("vec_id % 2 = 0")).collect()]
    v = {r.vec_id: list(r.v) for r in whole.collect()}
    assert set(v) == {*range(300), 304, 306, 400}
    want = []
    for q in v:
        if q % 2 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(found) == sorted(want)
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_toxicity_learns_words_and_pairs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(900):
        body = list(rng.choice(vocabulary, 30))
        if i % 4 == 0:
            body[5:7] = ["you", "idiot"]
        texts.append(" ".join(body))
        marks.append(int(i % 4 == 0))
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i < 600] + [(None, 1), (5, None), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(table, labels)
    assert len(model.buckets) < 500
    found = toxicity.score(table, model).collect()
    assert [r.predicted for r in sorted(found, key=lambda r: r.doc_id)][600:] == marks[600:]
    odd = toxicity.score(docs(spark, TEXTS), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.fit(docs(spark, []), labels).bias == 0


def test_suffix_automaton_and_parser_equal_brute_force():
    refs = [b"abracadabra alakazam", b"the cat sat on the mat"]
    parser = langid.Parser(refs)
    texts = [b"abracat", b"", b"zzz", b"the mat sat on abra", b"aabbrraa"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    got = parser.phrases(raw, np.cumsum(sizes) - sizes, sizes)

    def count(text, ref):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i:j + 1] in ref:
                j += 1
            n, i = n + 1, j
        return n

    assert got.tolist() == [[count(t, r) for r in refs] for t in texts]


def test_language(spark):
    table = docs(spark, ["the quick brown fox and the dog " * 3, "der schnelle braune fuchs und der hund " * 3] * 5).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.fit(table)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, ["brown dog and fox " * 300, "und der fuchs", None, "", "123 !", "é"]), model).collect()}
    assert found[0][0] == "en" and found[1][0] == "de" and found[0][1] > 0.5
    assert found[2] == found[3] == found[4] == ("und", 0.0) and found[5][0] in ("de", "en")
    none = langid.fit(table.limit(0))
    assert {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-notice"]
    edited = mit.replace("free of charge", "free of all charge")
    texts = [f"{PROSE}\n{mit.upper()}\n{PROSE}", "Released under\nthe MIT license", edited, "the MIT license was not released", *TEXTS]
    found = {r.doc_id: list(r.licenses) for r in licenses.scan(docs(spark, texts)).collect()}
    assert found[0] == ["MIT-notice"] and found[1] == ["MIT"] and found[2] == ["MIT-notice"] and found[3] == []
    assert all(found[i] == [] for i in range(4, len(texts)))
    assert licenses.scan(docs(spark, [])).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        body = list(rng.choice(vocabulary, rng.integers(30, 200)))
        for _ in range(12):
            copy = list(body)
            for at in rng.integers(0, len(copy), rng.integers(0, 8)):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [*TEXTS, "one two", "One Two", "one two three"]
    for percent in (85, 80):
        found = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), percent=percent).collect()}
        sets = []
        for t in texts:
            w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        low = list(range(len(texts)))
        changed = True
        while changed:
            changed = False
            for a in range(len(texts)):
                for b in range(a):
                    if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and low[a] != low[b]:
                        low[a] = low[b] = min(low[a], low[b])
                        changed = True
        assert [found[i].component_id for i in range(len(texts))] == low
        assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
        assert all(found[i].kept == (low[i] == i) for i in range(len(texts)))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    one = minhash.keep_one(docs(spark, ["a b c d e f", "a b c d e f", "x", "x", "", ""], ids=[1, 1, 2, 3, 4, 4]))
    assert sorted(r.doc_id for r in one.collect()) == [1, 2, 4]


def test_unlinked_texts_with_one_id_or_none_are_all_kept(spark):
    other, third = "a b c d e f g", "one two three four five six"
    texts = [PROSE * 4, other, third, PROSE * 4 + "end", other + " ", third, third, "p q r s t u", "p q r s t u", "", None]
    ids = [1, 1, None, None, None, None, 7, None, None, None, 8]
    table = docs(spark, texts, ids=ids)
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(table).collect()), key=str)
    assert kept == sorted([(1, PROSE * 4), (1, other), (7, third), (None, "p q r s t u"), (None, ""), (8, None)], key=str)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + 0.05 * rng.standard_normal(16)], int(i % 20 % 3)) for i in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [1.0, None], 0)]
    found = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, node int")).collect()}
    clean = {i: (np.array(v), g) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in found}
    for i, (x, g) in clean.items():
        for j, (y, h) in clean.items():
            if i < j and g == h and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    want, got = sum(map(len, links.values())), sum(r.n_links for r in found.values())
    assert 0.98 * want <= got <= want
    assert found[403].component_id == 0 and found[404].n_links == 0 and found[406].component_id == 405
    assert all(found[i].n_links == 0 and found[i].kept for i in (400, 401, 402, 404, 407))
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_bpe_equals_tiktoken(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "don't we'll 'r|e 'rerer   \n\n  x" * 40, "a" * 5000, " " * 777 + "x", "'" * 99 + "re", "日本語テキスト" * 90, "<|endoftext|>", "\U0001F600‍" * 50]
    for leaf in (3, 17, bpe.LEAF):
        out = bpe.decode(bpe.encode(docs(spark, texts), ranks, public_tokenizers.PATTERN, leaf=leaf), ranks)
        assert "text" not in out.columns and "score" in out.columns
        for r in out.collect():
            t = texts[r.doc_id] or ""
            assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(t)
            assert bytes(r.decoded).decode() == t
    assert bpe.encode(docs(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_every_token_encodes_to_itself(ranks):
    merges = bpe.Merges(ranks)
    assert all(merges.merge(token) == (i,) for token, i in ranks.items())
