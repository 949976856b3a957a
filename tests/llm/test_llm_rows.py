"""Secrets (5), shards (6), page text (4), quality (10)."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from llm_rows import no_docs, odd_docs  # noqa: F401
from rostercast.llm import block_labeller as pages
from rostercast.llm import pu_quality as quality
from rostercast.llm import random_secrets as secrets
from rostercast.llm import ring_shards as ring
from rostercast.llm.common import row_sample, table


# 5: secrets

def plain_spans(text):
    """The base patterns as the contract words them."""
    kinds = [(0, re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
             (1, re.compile("AKIA[A-Z0-9]+"), 0, 20), (2, re.compile("[0-9a-f]+"), 0, 24)]
    return sorted((m.start(), k, m.end()) for k, p, g, least in kinds for m in p.finditer(text) if len(m[g]) >= least)


def test_base_spans_equal_plain_patterns(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in table(spark, SMOKE_DIR, "documents").collect()]
    texts += ["token: token: abcdefgh", "API_KEY='x=y/z+1'", "paſsword=abcdefg", "secret==abcde", "toKen=abcdefg", "AKIA" + "A" * 15, "x" + "0" * 24 + "y"]
    for t in texts:
        assert secrets.base_spans(t or "") == plain_spans(t or "")


def test_secret_query_and_digest(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMOKE_DIR, "documents").collect()}
    for r in secrets.op5_random_secrets(spark, SMOKE_DIR).collect():
        base = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_battery_accepts_random_and_rejects_words():
    rng = random.Random(4)
    runs = ["".join(rng.choice(e) for _ in range(40)) for e in secrets.ENCODINGS for _ in range(200)]
    p = secrets.randomness(runs, [secrets.encoding(r) for r in runs])
    assert (p < secrets.FLOOR).mean() < 0.04
    texts = ["internationalizationofthe", "aaaaaaaaaaaaaaaaaaaaaaaa", "some-long-hyphenated-name", "abcdefghijklmnopqrstuvwxyz"]
    assert (secrets.randomness(texts, [secrets.encoding(r) for r in texts]) < secrets.FLOOR).all()


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice(secrets.ENCODINGS[6]) for _ in range(44))
    word = lambda: "".join(rng.choice(["tion", "the", "er", "an", "ing", "re", "ouen"]) for _ in range(8))
    docs = [(i, f"some words here {key() if i % 2 else word()} and more ordinary words after that one") for i in range(400)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).select("doc.doc_id", "spans").collect()}
    assert sum(bool(got[i]) for i in range(1, 400, 2)) >= 190
    assert not any(got[i] for i in range(0, 400, 2))


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.find_secrets(docs).select("doc.doc_id", "spans").collect()}


def plain_words(seed, n):
    rng = random.Random(seed)
    return [rng.choice(PLAIN) for _ in range(n)]


PLAIN = ("the of and to in is that for it was on are as with they be at one have this from by had not but what all were when we there can "
         "an your which their said if do will each about how up out them then she many some so these would other into has more two like "
         "him see time could no make than first been its who now people my made over did down only way find use may water long little "
         "very after words called just where most know").split()


def test_keys_among_keys_and_paths_are_found(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice(secrets.ENCODINGS[6]) for _ in range(rng.randint(36, 44)))
    path = lambda i: "/".join(plain_words(i, 9))
    lists = ["\n".join(f"{plain_words(i * 20 + j, 1)[0]} {key()}" for j in range(8)) for i in range(60)]
    paths = [" ".join([*plain_words(i, 30), *(path(i * 9 + j) for j in range(4)), *plain_words(-i, 30)]) for i in range(1, 120)]
    got = spans_of(spark, lists + paths)
    assert sum(len(got[i]) for i in range(60)) >= 0.95 * 480
    for t in lists:  # no word of a decoy is a part of a key
        assert set(secrets.ordinary_words(t, secrets.base_spans(t))) <= set(PLAIN)


def test_numbers_and_paths_of_clean_documents_are_no_secrets(spark):
    rng = random.Random(7)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(rng.randint(20, 23)))
    token = lambda i, sign: sign.join(plain_words(i, 5))[:27].ljust(20, "s")
    texts = [" ".join([*plain_words(i, 40), number(), *plain_words(i + 1000, 20), token(i, "/"), *plain_words(i + 2000, 20), token(-i, "_")]) for i in range(400)]
    assert sum(k == 3 for x in spans_of(spark, texts).values() for _, k, _ in x) <= 12  # of 1200 runs


def test_every_encoding_has_decoys_and_finds_long_keys(spark):
    rng = random.Random(8)
    kinds = [3, 4, 5, 6, 7, 8]
    keys = {k: ["".join(rng.choice(secrets.ENCODINGS[k]) for _ in range(70)) for _ in range(60)] for k in kinds}
    texts = [f"{' '.join(plain_words(i, 40))} {key} {' '.join(plain_words(-i, 40))}" for k in kinds for i, key in enumerate(keys[k])]
    got = spans_of(spark, texts)
    assert all(sum(bool(got[n * 60 + i]) for i in range(60)) >= 54 for n in range(len(kinds)))
    for k in range(len(secrets.ENCODINGS)):
        run = "".join(rng.choice(secrets.ENCODINGS[k]) for _ in range(300)) + ("" if k < 7 else secrets.ENCODINGS[k][-1])
        for words in ([], plain_words(k, 10), ["2019", *plain_words(k, 500)]):
            decoy = secrets.Decoys(words).next(run, k)
            assert len(decoy) == len(run) and set(decoy) <= secrets.SETS[k]
    assert 1 / secrets.BINS == secrets.FLOOR


def test_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), int(b), bool(d)) for c, b, d in zip(rng.choice([3, 41, 70], 4000), (rng.random(4000) ** 0.3 * 100).astype(int), rng.random(4000) < 0.5)]
    rows = [r for r in rows if not (r[2] and r[0] == 41 and r[1] >= 30) and not (r[2] and r[0] == 70 and r[1] >= 90)] + [(5, 99, True)]
    trials = spark.createDataFrame([([(0, 1, *r) for r in rows[i::7]],) for i in range(7)], f"trials {secrets.TRIAL}")
    expected = {}
    for c in {r[0] for r in rows}:
        for bin_ in range(int(secrets.FLOOR * secrets.BINS), secrets.BINS):
            runs, decoys = (sum(r[0] == c and r[1] >= bin_ and r[2] is is_decoy for r in rows) for is_decoy in (False, True))
            if runs and decoys <= secrets.FDR * runs:
                expected[c] = bin_
                break
    assert set(expected) == {41, 70} and secrets.thresholds(trials) == expected


def test_redaction_keeps_rows_and_columns(odd_docs, no_docs):
    got = secrets.redact(odd_docs)
    assert got.schema == odd_docs.schema and got.count() == odd_docs.count()
    by_id = {r.doc_id: r.text for r in got.collect()}
    assert by_id[17] == f"{secrets.MASK}\" and token: abc and {secrets.MASK} {secrets.MASK}"
    assert by_id[4] is None and by_id[5] == ""
    assert secrets.redact(no_docs).count() == 0


# 6: shards

def brute_ring(positions, shards, vnodes):
    """Keys at their points first, then the waiting ones clockwise, on plain lists."""
    def at(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)

    points = sorted((at(f"shard-{s}-{c}"), s) for s in range(shards) for c in range(vnodes))
    n = len(positions)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    arcs = [[] for _ in range(len(points) + 1)]
    for p in sorted(positions):
        i = next((i for i, (q, _) in enumerate(points) if p[0] <= q), len(points))
        arcs[i].append(p)
    out, waiting = {}, []
    for lap in range(2):
        for i, keys in enumerate(arcs):
            owner = points[i % len(points)][1]
            own = keys if lap == 0 else []
            stay, room_now = own[: room[owner]], room[owner]
            room[owner] -= len(stay)
            take = waiting[: room[owner]]
            room[owner] -= len(take)
            waiting = waiting[len(take):] + own[room_now:][: len(own) - len(stay)]
            for k in stay + take:
                out.setdefault(k, []).append(owner)
    assert not waiting
    return Counter((k[1], s) for k, own in out.items() for s in own)


@pytest.mark.parametrize("n,shards", [(0, 4), (3, 5), (500, 7)])
def test_ring_equals_plain_walk(spark, n, shards):
    docs = [(i * 37 - 100, "x" * (i % 9)) for i in range(n)]
    got = ring.ring_shards(spark.createDataFrame(docs, "doc_id long, text string"), shards=shards, vnodes=6).collect()
    want = brute_ring([(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i) for i, _ in docs], shards, 6)
    assert Counter((r.doc_id, r.shard) for r in got) == want


def check_shards(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = ring.ring_shards(odd_docs, shards=4).collect()
    check_shards(rows, 4)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in odd_docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert ring.ring_shards(no_docs).count() == 0


def test_an_id_with_all_rows_is_ranked_in_many_tasks(spark):
    docs = spark.createDataFrame([(7 if i % 4 else i, "x" * (i % 90)) for i in range(6000)], "doc_id long, text string").repartition(4)
    got = ring.ring_shards(docs, shards=5)
    rows = got.collect()
    check_shards(rows, 5)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d.doc_id, len(d.text) + 16) for d in docs.collect())
    want = brute_ring([(int(hashlib.md5(str(d.doc_id).encode()).hexdigest()[:8], 16), d.doc_id) for d in docs.collect()], 5, ring.VNODES)
    assert sum(want.values()) == len(rows)


def test_one_more_row_moves_little(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    a = {r.doc_id: r.shard for r in ring.ring_shards(docs, shards=8).collect()}
    b = {r.doc_id: r.shard for r in ring.ring_shards(docs.where("doc_id < 3990"), shards=8).collect()}
    assert sum(a[i] != b[i] for i in b) < 0.05 * len(b)


def test_shard_query_stays_in_the_engine(spark):
    df = ring.op6_ring_shards(spark, SMOKE_DIR)
    check_shards(df.collect(), ring.SHARDS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# 4: page text

def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", inner[1] if inner else "")
    return "\n\n".join(x for p in parts if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))).split())))


def test_page_query_gives_the_articles(spark):
    html_of = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = pages.op4_block_labeller(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(html_of) and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article(html_of[r.page_id]) for r in rows) >= 0.99 * len(rows)


OTHER = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><p>Welcome to our site, the best place for more.</p></header>
<div class="cookie-notice"><p>We use cookies to improve your experience on this site.</p></div><div id="menu"><ul><li><a href=a>One</a></li></ul></div>
<main><h1>The story</h1><p>First paragraph of the story with several words in it.<p>Second &amp; last paragraph,<br>with a   break &#233; and more words.</main>
<aside class="sidebar"><p>Other words are here and there in this side bar now.</p></aside>
<section class="comments"><div class="comment"><p>I think this article was really good, thanks for it.</p></div></section>
<form><label>Your reply</label></form><script>var x = "<p>no</p>";</script><footer><p>Copyright 2020 all rights reserved by us.</p></footer>"""


def test_labeller_reads_other_layouts(spark):
    sample = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    net = pages.trained(sample)
    read = pages.blocks(OTHER)
    marks = net.chosen([read])[0]
    assert [b[0] for b, m in zip(read, marks) if m] == [
        "The story", "First paragraph of the story with several words in it.", "Second & last paragraph, with a break é and more words."]


@pytest.mark.parametrize("before", [
    '<svg class="i"/>', '<object data="x" />', '<svg-icon name="x"></svg-icon>', "<select-box></select-box>", "<template-x>", "<script-loader src=a></script-loader>",
    "<svg><g>", "<object>", "<template>", "<select>", "<svg><text>not read</text></svg>", "<template><p>not read</p></template>", "<SELECT><option>not read</SELECT >",
    "<script>if (a < b) not read()</script>", "<style >p { }</style>", "<iframe src=x>not read</iframe>", "<noscript>not read</noscript>", "<textarea>not read</textarea>"])
@pytest.mark.parametrize("after", ["", "<svg><path/></svg><object></object><template></template><select></select>"])
def test_elements_before_the_article_do_not_swallow_it(before, after):
    closed_later = after and before in ("<svg><g>", "<object>", "<template>", "<select>")
    assert [t for t, _, _ in pages.blocks(f"{before}<article><p>All of it</p></article>{after}")] == ([] if closed_later else ["All of it"])


def test_raw_text_runs_to_the_end_and_many_open_elements_are_read():
    for tag in ("script", "style", "textarea", "iframe", "noscript"):
        assert pages.blocks(f"<p>read<{tag} x>not <p>read") == [("read", (("p",),), 0.0)]
    assert len(pages.blocks("<svg><p>x" * 20_000)) == 20_000


def nameless(seed):
    """A page whose wrappers have no telling names, and the blocks of its article."""
    rng = random.Random(seed)
    line = lambda least, most: " ".join(plain_words(rng.random(), rng.randint(least, most))).capitalize() + "."
    links = lambda n: "".join(f"<li><a href=x>{line(1, 3)}</a></li>" for _ in range(n))
    body = [("h1", line(2, 6)), ("p", line(20, 60))]
    for _ in range(rng.randint(2, 4)):
        body += [("h2", line(1, 4)), ("p", line(15, 60)), ("p", line(1, 6)), ("p", line(15, 60))]
    inner = "".join(f"<{tag}>{text}</{tag}>" for tag, text in body)
    return (f"<html><body><div><ul>{links(5)}</ul></div><div><div>{inner}</div><div><p>{line(1, 4)}</p><ul>{links(4)}</ul></div></div>"
            f"<div><p>{line(2, 5)}</p></div></body></html>"), [text for _, text in body]


def test_short_paragraphs_of_nameless_pages_stay():
    for i in range(20):
        page, article_ = nameless(i)
        read = pages.blocks(page)
        assert [b[0] for b, mark in zip(read, pages.told(read)) if mark] == article_
    net = pages.trained([nameless(i)[0] for i in range(100, 180)])
    right = 0
    for i in range(40):
        page, article_ = nameless(i)
        read = pages.blocks(page)
        right += [b[0] for b, mark in zip(read, net.chosen([read])[0]) if mark] == article_
    assert right >= 36


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    net = pages.Labeller()
    for k, w in enumerate(net.w):
        net.w[k] = w.astype(np.float64)
    x, mask = rng.normal(size=(2, 4, net.w[0].shape[0] - pages.HIDDEN)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 4)).astype(float)
    first = net.learn(x, mask, y)
    for _ in range(30):
        last = net.learn(x, mask, y)
    assert last < first / 2


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain text"), (5, "u", "<div>" * 3000 + "x"), (None, "u", OTHER), (6, "u", OTHER), (6, "u", OTHER),
            (7, "u", "<article><p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, row string")
    got = pages.main_text(df)
    assert got.columns == ["page_id", "url", "row", "text"] and got.count() == len(rows)
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[1] == texts[2] == ""
    assert pages.main_text(df.limit(0)).count() == 0


def test_pages_of_one_id_and_odd_column_names(spark):
    d = "/root/testdata/sf0.01"
    whole = table(spark, d, "pages")
    want = {r.html: r.text for r in pages.main_text(whole.select("html", F.col("html").alias("again"))).select(F.col("again").alias("html"), "text").collect()}
    for one in (7, 125):
        df = whole.select(F.lit(one).alias("page_id"), "html", F.col("html").alias("a b"), F.lit(1).alias("a-b"), F.lit("old").alias("text"))
        got = pages.main_text(df)
        assert got.columns == ["page_id", "a b", "a-b", "text"]
        assert all(r.text == want[r["a b"]] for r in got.collect())
    # one page many times, and one page only: the labeller is trained all the same
    copies = spark.range(300).select("id", F.lit(OTHER).alias("html"))
    assert len({r.text for r in pages.main_text(copies).collect()}) == 1


def test_samples_take_different_rows(spark):
    hot = spark.range(20_000).select(F.lit(5).alias("id"), F.lit("copy").alias("t"))
    rare = spark.range(3000).select(F.lit(5).alias("id"), F.concat(F.lit("t"), "id").alias("t"))
    assert row_sample(hot, 100).count() == 1
    assert 60 < row_sample(hot.union(rare), 100).count() < 150
    assert row_sample(rare, 10_000).count() == 3000
    assert row_sample(rare.limit(0), 10).count() == 0


# 10: quality

def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    rows = quality.op10_pu_quality(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("prior", [None, 0.3, 0.9])
def test_slopes_are_those_of_the_risk(prior):
    rng = np.random.default_rng(4)
    z, n = rng.normal(size=9) - (2 if prior == 0.9 else 0), 4

    def loss(z):
        s = 1 / (1 + np.exp(-z))
        p, u = s[:n], s[n:]
        if prior is None:
            return -np.log(p).mean() - np.log(1 - u).mean()
        negative = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        return -prior * np.log(p).mean() + negative if negative >= 0 else -negative

    s = 1 / (1 + np.exp(-z))
    steps = np.eye(len(z)) * 1e-6
    numeric = [(loss(z + d) - loss(z - d)) / 2e-6 for d in steps]
    assert np.allclose(quality.risk_slope(s[:n], s[n:], prior), numeric, atol=1e-7)


def test_slopes_step_back_where_the_risk_on_negatives_is_negative():
    sp, su = np.array([0.9, 0.8]), np.array([0.1, 0.2, 0.1])
    assert -np.log(1 - su).mean() + 0.5 * np.log(1 - sp).mean() < 0
    assert np.allclose(quality.risk_slope(sp, su, 0.5), [0.225, 0.2, -0.1 / 3, -0.2 / 3, -0.1 / 3])


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    p = rng.normal(1, 0.5, (3000, quality.WIDTH)).astype(np.float32)
    n = rng.normal(-1, 0.5, (3000, quality.WIDTH)).astype(np.float32)
    u = np.concatenate([p[:600], n[:2400]])
    u = u[rng.permutation(len(u))]
    assert abs(quality.class_prior(p[600:], u) - 0.2) < 0.05


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (10, 1, 0), (None, 1, 0), (7, None, 1), (12, 1, 0), (12, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(odd_docs, quality.fit(odd_docs, labels)).select("doc.*", "score")
    assert got.count() == odd_docs.count() and all(0 <= r[-1] <= 1 for r in got.collect())
    nothing = quality.keep_good(odd_docs, labels.limit(0))
    assert nothing.schema == odd_docs.schema and nothing.count() == odd_docs.count()
    assert quality.keep_good(no_docs, labels).count() == 0


def test_quality_of_one_id_and_odd_column_names(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(F.lit(1).alias("doc_id"), "text", F.col("text").alias("a b"), F.lit(2).alias("a-b"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns and got.count() <= docs.count()
    assert quality.fit(docs, labels) is not None
