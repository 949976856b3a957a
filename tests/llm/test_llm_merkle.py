"""The Merkle manifest against a plain tree, and on odd rows."""

import hashlib
import zlib

import pytest
from llm_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from rostercast.llm import merkle_manifest as M

LOWER = str.maketrans(M.UPPER, M.LOWER)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    values = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """The top of a tree and the siblings of every leaf, by lists."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, i in enumerate(where):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            where[leaf] = i // 8
        nodes = [digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0] if nodes else None, paths


def brute(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(r)
    tops = []
    for g in sorted(groups):
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)))
        tops.append(plain_tree([plain_leaf(r, r.text) for r in groups[g]]))
    root, above = plain_tree([t for t, _ in tops])
    for g, (subroot, paths), up in zip(sorted(groups), tops, above, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            tamper = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            f = plain_leaf(r, r.text.translate(LOWER) if tamper and r.text is not None else r.text)
            for a, b in path + up:
                f = digest(a, f, b)
            out.append((r.doc_id, plain_leaf(r, r.text), subroot, root, digest(*[a + b for a, b in path + up]), f, f == root))
    return sorted(out, key=repr)


def manifest(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = M.op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def test_odd_rows_equal_a_plain_tree(spark, odd_docs, tmp_path):
    got = manifest(spark, odd_docs, tmp_path)
    assert got == brute(odd_docs.collect())
    assert {r[0] for r in got if not r[6]} and any(r[6] for r in got)


@pytest.mark.parametrize("langs", [1, 11, 70])
def test_sizes_and_language_counts(spark, tmp_path, langs):
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text No "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("l0")).otherwise(F.concat(F.lit("l"), (F.col("id") % langs).cast("string"))).alias("lang"),
        F.lit(None).cast("string").alias("source"), F.lit(3).alias("n_chars"), F.lit(1).alias("a b"), F.lit("x").alias("leaf"))
    assert manifest(spark, docs, tmp_path) == brute(docs.collect())


def test_empty_and_single(spark, no_docs, tmp_path):
    assert manifest(spark, no_docs, tmp_path / "none") == []
    one = spark.createDataFrame([(5, "A", None, None, 1)], no_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    (row,) = manifest(spark, one, tmp_path / "one")
    assert row[1] == row[2] == row[3] and row[4] == digest()


def test_broadcast_and_shuffled_jumps_agree(spark, odd_docs, tmp_path, monkeypatch):
    first = manifest(spark, odd_docs, tmp_path / "a")
    monkeypatch.setattr(M, "BROADCAST_NODES", -1)
    assert manifest(spark, odd_docs, tmp_path / "b") == first


def test_a_forged_leaf_does_not_verify(spark, odd_docs):
    out = M.proofs(M.leaves(odd_docs)).withColumn("forged", F.unhex(F.sha2(F.lit("x"), 256)))
    rows = out.select(M.folded("leaf").alias("a"), M.folded("forged").alias("b"), "root").collect()
    assert all(r.a == r.root and r.b != r.root for r in rows)
