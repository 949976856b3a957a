"""Operators on token ids: sampled pieces (1), packing (2), token files (8)."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from llm_rows import no_docs, odd_docs  # noqa: F401
from rostercast.llm import fit_packing as packing
from rostercast.llm import pfor_files as files
from rostercast.llm import sampled_pieces as pieces
from rostercast.llm.common import new_folder, table
from rostercast.llm.tokens import vocabulary_path, word_ids


@pytest.fixture(scope="module")
def store():
    return word_ids(vocabulary_path())


def whole_ids(store, text):
    return np.frombuffer(store.encode_whole(text or "") + b"\2\0\0\0", "<u4")


def test_word_store_equals_the_library(store):
    rng = random.Random(3)
    signs = " \n\t,.'sabé1日 \xa0!x"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "it's they've", "...", "é, ß. Ñ\nü.", "a\x1cb c\x85d", "x" * 5000]
    wrong = [t for t in texts if store.encode(t) != store.encode_whole(t)]
    assert not wrong, wrong[:5]


def test_word_store_on_the_documents(spark, store):
    for r in table(spark, SMOKE_DIR, "documents").collect():
        assert store.encode(r.text or "") == store.encode_whole(r.text or "")


# 1: sampled pieces

def lattice_paths(lat, s):
    if not s:
        return {(): 1.0}
    out = {}
    for e in range(1, len(s) + 1):
        if s[:e] in lat.pieces:
            i, w = lat.pieces[s[:e]]
            for rest, x in lattice_paths(lat, s[e:]).items():
                out[i, *rest] = w * x
    return out


@pytest.mark.parametrize("word", ["the", "ing,", "a"])
def test_samples_follow_the_exact_path_probabilities(word):
    lat = pieces.lattices(pieces.model_path())
    exact = lattice_paths(lat, pieces.MARK + word)
    total, n = sum(exact.values()), 20_000
    drawn = Counter(tuple(np.frombuffer(b, "<u4").tolist()) for b in lat.encode([word] * n, list(range(n)), 9))
    assert set(drawn) <= set(exact)
    for path, w in exact.items():
        p = w / total
        assert abs(drawn[path] / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_samples_depend_on_seed_and_key_only(odd_docs):
    a = {(r.doc_id, r.ids) for r in pieces.sample_pieces(odd_docs).collect()}
    b = {(r.doc_id, r.ids) for r in pieces.sample_pieces(odd_docs.repartition(7)).collect()}
    c = {(r.doc_id, r.ids) for r in pieces.sample_pieces(odd_docs, seed=99).collect()}
    assert a == b and a != c


def test_pieces_decode_to_the_text(odd_docs, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    got = pieces.sample_pieces(odd_docs).cache()
    assert all(r.lossless is not False for r in got.collect())
    assert Counter((r.doc_id, r.text) for r in pieces.decode_pieces(got).collect()) == texts
    for r in got.collect():
        if r.ids:
            text = model.decode(np.frombuffer(r.ids, "<u4").tolist())
            assert (r.doc_id, text) in texts
    assert pieces.sample_pieces(no_docs).count() == 0


# 2: packing

@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([7, 32, 200]))
    n = int(rng.integers(0, 600))
    lengths = np.minimum(size, 1 + rng.exponential(size / 3, n).astype(int)) if seed % 3 else rng.choice([1, size // 3 + 1, size // 2 + 1], n)
    plan = packing.plan_patterns(dict(Counter(lengths.tolist())), size)
    used = Counter()
    for held, times in plan:
        assert sum(held) <= size and times > 0
        for x in held:
            used[x] += times
    assert used == Counter(lengths.tolist())
    plain = packing.plan_with(dict(Counter(lengths.tolist())), size, 0) if n else []
    assert sum(k for _, k in plan) <= max(sum(k for _, k in plain), -(-int(lengths.sum()) // size) + 1)


def test_a_small_store_forgets_words_and_keeps_the_ids():
    texts = [" ".join(random.Random(i).choices(["alpha", "beta,", "gamma.", "Straße", "x1", "d\ne", "öl,", "ZZ"], k=40)) for i in range(20)]
    small = word_ids(vocabulary_path(), 3)
    for t in texts:
        assert small.encode(t) == small.encode_whole(t)
        assert len(small.older) <= 3 + 2 and len(small) <= 3 + 2  # a word may bring its core and its signs


@pytest.mark.parametrize("seed", range(6))
def test_sum_index_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([6, 17, 40]))
    index = packing.Complements({int(x): int(k) for x, k in zip(range(1, size + 1), rng.integers(0, 4, size), strict=True)}, size)
    for _ in range(60):
        index.put(int(rng.integers(1, size + 1)), int(rng.integers(0, 5)))
        there = [x for x in range(1, size + 1) for _ in range(min(3, index.n[x]))]
        made = {k: {tuple(sorted(c)) for c in itertools.combinations(there, k)} for k in (2, 3)}
        for total in range(size + 1):
            pairs, triples = ([c for c in made[k] if sum(c) == total] for k in (2, 3))
            found = index.pair(total)
            assert found == (max(pairs, key=lambda c: c[-1])[::-1] if pairs else None)
            found = index.triple(total)
            assert (found is None) == (not triples)
            if triples:
                assert tuple(sorted(found)) == min(triples, key=lambda c: (c[0], -c[-1]))
            assert (index.find(total) is None) == (not (pairs or triples or (total and index.n[total])))


def check_packing(rows, docs, store, size):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    ids = {}
    for d in docs:
        ids.setdefault(d.doc_id, []).append(whole_ids(store, d.text))
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        want = Counter()
        for x in ids[i]:
            for n, (a, b) in enumerate(packing.cut(len(x), size)):
                want[n, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in own) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [64, 1024])
def test_packing_places_every_id_once(odd_docs, store, size):
    rows = packing.pack_documents(odd_docs, size=size).collect()
    n = check_packing(rows, odd_docs.collect(), store, size)
    assert n <= -(-sum(r.length for r in rows) // size) + 2


def test_packing_query_and_its_sequences(spark, store):
    rows = packing.op2_fit_packing(spark, SMOKE_DIR)
    docs = table(spark, SMOKE_DIR, "documents")
    n = check_packing(rows.collect(), docs.collect(), store, packing.SEQUENCE)
    got = packing.sequences(docs, rows).collect()
    assert len(got) == n and sum(len(r.ids) for r in got) // 4 == sum(r.length for r in rows.collect())


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


# 8: token files

@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
def test_images_keep_every_id_and_any_range(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 50257).astype("<u4") if n else np.zeros(0, "<u4")
    image = files.pack_image([7, None], [n, 0], ids)
    docs, back = files.read_image(image)
    assert np.array_equal(back, ids) and docs["id"].tolist() == [7, 0] and docs["known"].tolist() == [1, 0]
    for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n)):
        if 0 <= a < b <= n:
            assert np.array_equal(files.read_image(image, a, b)[1], ids[a:b])


def test_token_files_of_odd_rows(spark, odd_docs, no_docs, store):
    for docs in (odd_docs, no_docs):
        path = new_folder(spark, "test-files")
        files.write_token_files(docs, path)
        got = sorted(files.read_token_files(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((d.doc_id for d in docs.collect()), key=lambda i: (i is not None, i))
        at = 0
        for r in got:
            assert r.start == at
            at += len(r.ids) // 4
        want = Counter((d.doc_id, whole_ids(store, d.text).tobytes()) for d in docs.collect())
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_an_id_with_all_rows_spans_partitions(spark, store, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i % 50} of one id") for i in range(4000)], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "hot")
    files.write_token_files(docs, path)
    parts = [r.n for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(parts) == 4000 and max(parts) < 2000
    got = files.read_token_files(spark, path).collect()
    assert Counter(bytes(r.ids) for r in got) == Counter(whole_ids(store, d.text).tobytes() for d in docs.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4


def test_token_file_query(spark, store):
    rows = {r.doc_id: r for r in files.op8_pfor_token_files(spark, SMOKE_DIR).collect()}
    at = 0
    for d in table(spark, SMOKE_DIR, "documents").orderBy("doc_id").collect():
        ids = whole_ids(store, d.text)
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
