"""Decontamination against a plain search of every window at every place, and on odd rows."""

import hashlib
import re

from llm_rows import no_docs, odd_docs, words  # noqa: F401
from pyspark.sql import functions as F
from rostercast.llm import prefix_decontamination as P

LOWER = str.maketrans(P.UPPER, P.LOWER)


def plain_words(text):
    return re.findall(P.WORD, (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i:i + 10]), set()).add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[tuple(w[p:p + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, words(1, 40)), (2, words(1, 40)), (10, "one two"), (3, "one"), (3, words(4, 30)), (None, words(3, 12)), (5, None), (6, ""), (7, "é é é é é é é é é é é"),
         (8, words(3, 9)), (9, "日本語 \U0001f600"), (11, words(50, 25)), (12, words(1, 25) + " " + words(60, 3))]


def solve(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns({"token": F.lit(1), "a b": F.lit(2)}).write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted([tuple(r) for r in P.op12_prefix_decontamination(spark, str(tmp_path)).collect()], key=repr)


def with_planted(spark, odd_docs):
    rows = [(100, "é " * 30), (101, "x " + words(50, 25).upper() + " y"), (102, words(50, 9) + " cut " + " ".join(words(50, 25).split()[9:18])),
            (103, ". ".join(words(1, 40).split()[5:15])), *[(200 + i, "a a a " + words(4, 30)) for i in range(40)]]
    return odd_docs.select("doc_id", "text", "lang", "n").unionByName(spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id long, text string, lang string, n long"))


def test_odd_rows_equal_brute_force(spark, odd_docs, no_docs, tmp_path):
    docs = with_planted(spark, odd_docs)
    got = solve(spark, docs, ITEMS, tmp_path / "a")
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert sum(r[5] for r in got) > 40
    assert solve(spark, no_docs, ITEMS, tmp_path / "b") == []
    none = solve(spark, docs, [], tmp_path / "c")
    assert none == brute([(r.doc_id, r.text) for r in docs.collect()], [])


def test_benchmark_in_blocks(spark, odd_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 40)
    docs = with_planted(spark, odd_docs)
    assert solve(spark, docs, ITEMS, tmp_path) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_plan_is_native(spark):
    docs, bench = (spark.createDataFrame([(1, "a b c")], f"{k} long, text string") for k in ("doc_id", "item_id"))
    hashed = docs.select(P.words_of("text").alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    plan = P.rarity(hashed, P.window_table(P.windows_of(bench)), [3])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "regexp_extract_all" in plan
    assert plan.count("regexp_extract_all(translate(text") <= plan.count("FileScan") + plan.count("ExistingRDD") + 2  # words once for each text
