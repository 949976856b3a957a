"""Near duplicates (3), nearest neighbours (7), vector duplicates (9), components."""

from collections import defaultdict

import numpy as np
import pytest

from conftest import SMOKE_DIR
from llm_rows import no_docs, odd_docs  # noqa: F401
from rostercast.llm import minhash_dedup as near
from rostercast.llm import range_dedup as ranges
from rostercast.llm import tree_search as search
from rostercast.llm.common import connected_components, table
from rostercast.llm.vectors import valid_vectors


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 100), (None, 5)]])
def test_components(spark, edges):
    sets = Sets()
    for a, b in edges:
        if None not in (a, b) and a != b:
            sets.join(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up}


# 3: near duplicates

def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute_groups(rows, size, share):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    by_shingle, joined = defaultdict(list), Sets()
    distinct = {}
    for i, s in sets:
        if i is None or not s:
            continue
        joined.find(i)
        if s in distinct:
            joined.join(distinct[s], i)
        else:
            distinct[s] = i
    for s, i in distinct.items():
        for x in s:
            by_shingle[x].append((i, s))
    seen = set()
    for own in by_shingle.values():
        for a, s in own:
            for b, t in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(s & t)
                    if 100 * both >= share * (len(s) + len(t) - both):
                        joined.join(a, b)
    return [(i, len(s), joined.find(i) if i is not None and s else i) for i, s in sets]


def check_groups(docs, size, share):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(brute_groups([(r.doc_id, r.text) for r in rows], size, share), key=str)
    got = near.near_duplicates(docs, words=size, share=share).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    check_groups(odd_docs, 3, 85)
    assert near.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("size,share", [(3, 85), (5, 80)])
def test_near_duplicates_of_the_documents(spark, size, share):
    check_groups(table(spark, "/root/testdata/sf0.01", "documents"), size, share)


def test_group_around_a_base_with_noisy_copies(spark):
    """Copies that link to the base, to each other only, or to nothing."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(90, int(rng.integers(0, 7)), replace=False):
            words[at] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(words)))
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_pairs_and_edges_of_a_group_of_copies_grow_with_its_size(spark, monkeypatch):
    """The least documents link with nothing, so the first stars leave all open; of the others, two with three changes each are not linked."""
    monkeypatch.setattr(near, "RARE", 0)
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(300):
        words = list(base)
        for at in rng.choice(200, 6 if i < 10 else 3 if i % 10 < 7 else 2, replace=False):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    counts = {"pairs": 0, "edges": 0}
    confirm, components = near.confirmed, near.connected_components

    def confirmed(pairs, *rest):
        counts["pairs"] += pairs.count()
        return confirm(pairs, *rest)

    def joined(edges, *rest):
        counts["edges"] += edges.count()
        return components(edges, *rest)

    monkeypatch.setattr(near, "confirmed", confirmed)
    monkeypatch.setattr(near, "connected_components", joined)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert counts["pairs"] < 40 * len(rows) and counts["edges"] < 20 * len(rows)


def test_members_of_heavy_and_light_buckets_meet_their_row(spark, monkeypatch):
    monkeypatch.setattr(near, "HEAVY", 4)
    rows = [(i, i % 5 + 1, 0 if i % 3 == 0 else i // 2) for i in range(300)]
    members = spark.createDataFrame(rows, "doc_id long, n long, band long")
    size = defaultdict(int)
    for _, _, band in rows:
        size[band] += 1
    buckets = spark.createDataFrame([(b, c) for b, c in size.items() if c > 1], "band long, size long")
    assert max(size.values()) * 4 >= len(rows)
    got = near.with_bucket(members, buckets).select("doc_id", "n", "band", "size")
    assert sorted(map(tuple, got.collect())) == sorted((*r, size[r[2]]) for r in rows if size[r[2]] > 1)
    assert near.with_bucket(members.limit(0), buckets.limit(0)).count() == 0


def test_light_members_are_not_joined_to_be_kept(spark, monkeypatch):
    monkeypatch.setattr(near, "HEAVY", 4)
    members = spark.createDataFrame([(i, 1, 0 if i % 3 == 0 else i // 2) for i in range(300)], "doc_id long, n long, band long")
    buckets = members.groupBy("band").count().select("band", near.F.col("count").alias("size"))
    for size, heavy in (("size", True), ("1L", False)):
        got = near.with_bucket(members, buckets.selectExpr("band", f"{size} as size"))
        assert got.count() == 300 and got.select("doc_id").distinct().count() == 300
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and plan.count("Join Inner") == 1 + heavy


def test_superminhash_estimates_the_similarity():
    rng = np.random.default_rng(1)
    seen = []
    for _ in range(40):
        x = rng.integers(0, 1 << 62, 800).astype(np.uint64)
        s = near.superminhash([np.unique(x[:700]), np.unique(x[100:])], 140)
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(seen) - 0.75) < 0.02 and np.std(seen) < (0.75 * 0.25 / 140) ** 0.5 * 1.2


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 3, 40, 900)]
    together = near.superminhash(sets, 50)
    for s, row in zip(sets, together):
        assert np.array_equal(near.superminhash([s], 50)[0], row)
        want = np.full(50, near.FREE)
        for x in s:  # one element after the other, as published
            p = list(range(50))
            for j in range(50):
                r = int(near.mixed(np.array([(int(x) + (j + 1) * int(near.STEP)) % (1 << 64)], np.uint64))[0])
                k = j + ((r & 0xFFFFFFFF) * (50 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], np.uint64((j << 32) | (r >> 32)))
        assert np.array_equal(want, row)


# vectors

def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in vectors], "vec_id long, embedding array<float>, label int, v string, id long, leaf int")


ODD = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]),
       (8, [None, 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]),
       (12, [1.0, 0.0]), (100, [0.0, 0.0, 1.0]), (200, [1.0, 0.0, 0.0])]


def test_valid_vectors(spark):
    got = sorted(r.id for r in valid_vectors(vector_table(spark, ODD)).collect())
    assert got == [1, 2, 3, 10, 10, 11, 12, 100, 200]


def test_vector_duplicates_of_odd_rows(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ranges.range_duplicates(vector_table(spark, ODD)).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[200] == (3, 1, False)
    assert got[11] == (2, 10, False) and got[10] == (2, 10, True)
    for i in (4, 5, 6, 7, 8, 9, 12, 100):
        assert got[i] == (0, i, True)
    assert ranges.range_duplicates(vector_table(spark, ODD).limit(0)).count() == 0


def test_vector_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    monkeypatch.setattr(ranges, "STRIPE", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 8)) * 0.25, rng.normal(size=(200, 8))]).astype(np.float32)
    x[650:] = x[0]
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    sets = Sets()
    for a, b in zip(*np.nonzero(linked)):
        sets.join(int(a), int(b))
    got = {r.vec_id: (r.n_links, r.component_id) for r in ranges.range_duplicates(vector_table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert got == {i: (int(linked[i].sum()), sets.find(i)) for i in range(len(x))}


def test_boundary_replication_loses_no_neighbour():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(800, 6))
    u /= np.sqrt((u * u).sum(1))[:, None]
    eps = 0.4
    home, needs = ranges.cells_of(u, u[:15], eps)
    near_ = ((u[:, None] - u[None]) ** 2).sum(2) <= eps * eps
    for a, b in zip(*np.nonzero(near_)):
        assert needs[b, home[a]]


# 7: nearest neighbours

def test_pivots_only_where_they_keep_cells_apart():
    rng = np.random.default_rng(5)
    eps, rows = np.sqrt(2 - 2 * ranges.COSINE), 1_000_000
    even = ranges.unit(rng.normal(size=(2000, 64)))
    centre = ranges.unit(rng.normal(size=(32, 64)))
    apart = ranges.unit(centre[rng.integers(0, 32, 2000)] + rng.normal(size=(2000, 64)) * 0.005)
    assert ranges.pivot_count(even, ranges.spread_pivots(even, 100), eps, rows) == 1
    pivots = ranges.spread_pivots(apart, 100)
    assert ranges.pivot_count(apart, pivots, eps, rows) >= 32
    assert ranges.pivot_count(apart[:1], pivots[:1], eps, 1) == 1


def test_tree_recall_and_scores(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    got = defaultdict(list)
    for r in search.op7_tree_search(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [s for _, _, s in own] == sorted(s for _, _, s in own)
        assert all(s == d[ids == v][0] for _, v, s in own)
        hits += len(set(ids[best]) & {v for _, v, _ in own})
    assert hits / (10 * len(got)) >= 0.9 and len(got) == (ids % 100 == 0).sum()


def test_walk_meets_every_leaf_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 5))
    tree = search.Tree(x, 1.0, 100)
    order = list(tree.walk(x[7]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.leaf_of(x[7:8])[0]


def test_nearest_of_odd_rows(spark):
    got = search.nearest(vector_table(spark, ODD)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id))
    assert set(by) == {100, 200}
    assert [v for _, v in sorted(by[200])][:3] == [1, 3, 2] and 12 not in [v for _, v in by[200]]
    assert search.nearest(vector_table(spark, ODD).limit(0)).count() == 0


def test_an_id_with_most_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    rows = [(7 if i % 3 else 100 * (i % 9), v.tolist()) for i, v in enumerate(x)]
    got = search.nearest(vector_table(spark, rows)).collect()
    assert {r.query_id for r in got} == {100 * i for i in range(0, 9, 3)}
    own = [(7, x[1].tolist()), (7, (2 * x[1]).tolist()), (7, x[2].tolist()), (8, x[2].tolist())] + [(7, v.tolist()) for v in x[:500]]
    found = {(r.vec_id, r.component_id) for r in ranges.range_duplicates(vector_table(spark, own)).collect()}
    assert found == {(7, 7), (8, 7)}


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    rows = [(i, [1.0, float(i % 2)]) for i in range(0, 300)]
    got = defaultdict(list)
    for r in search.nearest(vector_table(spark, rows)).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[100])] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18]


def test_queries_of_a_leaf_come_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    real = search.best

    def limited(q_ids, q, ids, rows, k):
        assert len(q) <= 64, "too many queries at once"
        return real(q_ids, q, ids, rows, k)

    monkeypatch.setattr(search, "best", limited)
    for name, value in (("BLOCK", 100), ("GROUP", 16), ("TRIALS", 20)):
        monkeypatch.setattr(search, name, value, raising=False)
    got = defaultdict(list)
    for r in search.nearest(vector_table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=1).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all([v for _, v in sorted(got[i])] == np.argsort(d[i])[:10].tolist() for i in range(600))


def test_distances_are_worked_out_in_stripes(monkeypatch):
    rng = np.random.default_rng(10)
    q, x, seen, real = rng.normal(size=(1000, 3)), rng.normal(size=(50, 3)), [], search.distances
    monkeypatch.setattr(search, "distances", lambda a, b: seen.append(len(a)) or real(a, b))
    got = search.best(np.arange(1000) + 100, q, np.arange(50), x, 3)
    assert max(seen) <= 256 and sum(seen) == 1000
    want = np.argsort(((q[:, None] - x) ** 2).sum(2), axis=1)[:, :3]
    assert [v for _, v, _ in got] == want.ravel().tolist() and [i for i, _, _ in got] == np.repeat(np.arange(1000) + 100, 3).tolist()


def test_queries_read_the_whole_tables(spark):
    assert near.op3_minhash_dedup(spark, SMOKE_DIR).count() == table(spark, SMOKE_DIR, "documents").count()
    assert ranges.op9_range_dedup(spark, SMOKE_DIR).count() == table(spark, SMOKE_DIR, "embeddings").count()
