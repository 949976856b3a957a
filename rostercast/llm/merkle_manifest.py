"""Merkle manifest of a corpus: every row is a leaf and carries the proof that it belongs to the root.

Leaves of a language stand in order of their id; every ``FANOUT`` consecutive nodes
become one node, until one remains for each language (its subroot).  The subroots,
in order of language, form a tree of the same kind; what remains is the root.

Proofs come from pointer jumping.  Every inner node holds the siblings on the way
to the node it points to, at first its parent (a subroot points into the tree of
the languages).  A self-join on the node pointed to appends that node's siblings
and takes over its pointer, so the distance doubles each round and all inner nodes
hold their whole way to the root after log2(height) rounds.  No node points at a
leaf, so leaves wait for the last self-join, with their parents, a run of leaves
at a time.

Scale: positions come from a range partitioning by (language, id, leaf) and counts
of each range, so a language with any share of the rows, and an id that repeats,
is dealt over many tasks.  A run has at most ``FANOUT`` nodes; keys of the self-joins
collect at most ``FANOUT ** distance`` rows, and the few nodes that distant pointers
meet are broadcast only where their counted number is below ``BROADCAST_NODES``.

Nulls: a null column counts as ``-`` in its leaf; null ids come first in their
language, rows without a language first among languages.  Rows that repeat an id
are ordered by leaf; equal rows are leaves of their own at interchangeable places.
An empty table has no root and gives no rows.  Texts are hashed whole, whatever
their length; columns other than the five are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import placed, staged, table

FANOUT = 8
BROADCAST_NODES = 20_000   # at most about 30 MB with the siblings of ten levels
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed order of the contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = "^"  # the tree of the languages; languages themselves are "" (null) or "=" and the name
PATH = "array<struct<left:binary,right:binary>>"


def hash_of(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The leaf of a row: ``-`` for a null, else byte count, colon and value, in the order of ``LEAF_COLUMNS``."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return hash_of(*[field(columns[c]) for c in LEAF_COLUMNS])


def leaves(docs: DataFrame, **payload: Column) -> DataFrame:
    """``(doc_id, lang, leaf)`` of every row, and the columns of ``payload``."""
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"),
                       leaf_hash({c: F.col(c) for c in LEAF_COLUMNS}).alias("leaf"),
                       *[c.alias(name) for name, c in payload.items()])


def runs_of(nodes: DataFrame, *payload: str) -> DataFrame:
    """Runs of ``FANOUT`` nodes: ``(g, up, n, kids, digest)``; a lone node is its own parent, not hashed again."""
    runs = nodes.groupBy("g", F.expr(f"idx div {FANOUT}").alias("up")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest", *payload))).alias("kids"))
    together = F.expr("aggregate(kids, cast('' as binary), (a, k) -> concat(a, k.digest))")
    return runs.withColumn("digest", F.when(F.col("n") > 1, hash_of(hexed(together))).otherwise(F.col("kids")[0]["digest"]))


def each_kid(*fields: str) -> Column:
    """Kids of a run as rows with ``fields`` and ``step``: the siblings to the left and to the right, concatenated."""
    side = "aggregate({}, cast('' as binary), (a, s) -> concat(a, s.digest))"
    kept = "".join(f"'{f}', k.`{f}`, " for f in fields)
    return F.expr(f"""inline(transform(kids, (k, i) -> named_struct({kept}'step', named_struct(
      'left', {side.format('slice(kids, 1, i)')}, 'right', {side.format(f'slice(kids, i + 2, {FANOUT})')}))))""")


def grow(nodes: DataFrame, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """All levels above ``nodes`` ``(g, idx, n, digest)``: the top of every group, and the steps of all other nodes.

    Steps are ``(g, level, idx, path, to_level, to_idx)``; one round of the loop is one level
    of all groups at once, an eighth of the rows of the one before.
    """
    tops, steps = [], []
    while True:
        tops.append(nodes.where("n = 1").select("g", F.lit(level).alias("level"), "digest"))
        live = nodes.where("n > 1")
        if live.isEmpty():
            break
        runs = staged(runs_of(live), "runs")
        steps.append(runs.select("g", "up", each_kid("idx")).select("g", F.lit(level).alias("level"), "idx", F.array("step").alias("path"),
                                                                    F.lit(level + 1).alias("to_level"), F.col("up").alias("to_idx")))
        nodes = runs.select("g", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "digest")
        level += 1
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return top, steps


def jump(nodes: DataFrame) -> DataFrame:
    """Pointer jumping: ``nodes`` with the whole ``path`` to the root and the ``subroot`` they pass.

    ``nodes`` are ``(g, level, idx, path, subroot, to_g, to_level, to_idx)``; a null pointer is at the root.
    """
    distance = 1
    while not nodes.where("to_g is not null").isEmpty():
        # after pointers of this distance only these nodes can be met
        met = nodes.where((F.col("g") == TOP) | (F.col("level") > distance)).select(
            F.col("g").alias("to_g"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("path").alias("further"),
            F.col("subroot").alias("s2"), F.col("to_g").alias("g2"), F.col("to_level").alias("l2"), F.col("to_idx").alias("i2"))
        if met.count() <= BROADCAST_NODES:
            met = F.broadcast(met)
        further = F.coalesce("further", F.array().cast(PATH))
        nodes = staged(nodes.join(met, ["to_g", "to_level", "to_idx"], "left").select(
            "g", "level", "idx", F.concat("path", further).alias("path"), F.coalesce("subroot", "s2").alias("subroot"),
            F.col("g2").alias("to_g"), F.col("l2").alias("to_level"), F.col("i2").alias("to_idx")), "pointers")
        distance *= 2
    return nodes


def proofs(rows: DataFrame, *payload: str) -> DataFrame:
    """The proof of every leaf of ``rows`` ``(doc_id, lang, leaf, payload…)``.

    Returns ``(doc_id, leaf, payload…, path, subroot, root)``; ``path`` lists, level by level, the
    concatenated digests to the left and to the right of the node on the way.
    """
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    ordered = placed(rows.select(group.alias("g"), "doc_id", F.col("leaf").alias("digest"), *payload), "g", ["doc_id", "digest"])
    runs = staged(runs_of(ordered, "doc_id", *payload), "runs")
    parents = runs.select("g", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "digest")
    top, steps = grow(parents, 1)
    subroots = staged(top, "subroots")
    langs = placed(subroots.withColumn("t", F.lit(TOP)), "t", ["g"])
    langs = staged(langs.select(F.lit(TOP).alias("t"), "g", "level", "digest", "idx", "n"), "languages")
    root_row, above = grow(langs.select(F.col("t").alias("g"), "idx", "n", "digest"), 0)
    root = root_row.select(hexed("digest").alias("root")).first()
    root = root["root"] if root else None

    # a subroot is a leaf of the tree of the languages: its step is the step of that leaf
    nothing = F.array().cast(PATH)
    own = langs.select("g", "level", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), F.col("idx").alias("at"))
    if above:
        first = above[0].select(F.col("idx").alias("at"), "path", "to_level", "to_idx")
        own = own.join(first, "at")
    else:
        own = own.withColumns({"path": nothing, "to_level": F.lit(None).cast("int"), "to_idx": F.lit(None).cast("long")})
    last = len(above)  # the level of the root in the tree of the languages

    def pointers(df: DataFrame, to_g: Column) -> DataFrame:
        return df.select("g", F.col("level").cast("int").alias("level"), F.col("idx").cast("long").alias("idx"), F.col("path").cast(PATH).alias("path"),
                         F.col("subroot").cast("binary").alias("subroot"), to_g.cast("string").alias("to_g"),
                         F.when(to_g.isNotNull(), F.col("to_level")).cast("int").alias("to_level"),
                         F.when(to_g.isNotNull(), F.col("to_idx")).cast("long").alias("to_idx"))

    into_top = F.when(F.col("to_level") < last, F.lit(TOP))
    nodes = pointers(own, into_top)
    for s in steps:
        nodes = nodes.unionByName(pointers(s.withColumn("subroot", F.lit(None)), F.col("g")))
    for s in above[1:]:
        nodes = nodes.unionByName(pointers(s.withColumn("subroot", F.lit(None)), into_top))
    ways = jump(staged(nodes, "pointers")).where((F.col("level") == 1) & (F.col("g") != TOP)).select(
        "g", F.col("idx").alias("up"), F.col("path").alias("further"), "subroot")
    each = runs.join(ways, ["g", "up"]).select("further", "subroot", "n", each_kid("digest", "doc_id", *payload)).withColumnRenamed("digest", "leaf")
    path = F.when(F.col("n") > 1, F.concat(F.array("step"), F.col("further"))).otherwise(F.col("further"))
    return each.select("doc_id", "leaf", *payload, path.alias("path"), "subroot", F.lit(root).alias("root"))


def proof_hash(path: str = "path") -> Column:
    """SHA-256 of all siblings of a path as hex text."""
    return F.sha2(hexed(F.expr(f"aggregate({path}, cast('' as binary), (a, s) -> concat(a, s.left, s.right))")), 256)


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and a path lead to, as hex text."""
    return F.expr(f"aggregate({path}, lower(hex({leaf})), (a, s) -> sha2(concat(lower(hex(s.left)), a, lower(hex(s.right))), 256))")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = {c: F.col(c) for c in LEAF_COLUMNS} | {"text": F.translate("text", UPPER, LOWER)}
    rows = leaves(docs, seen=F.when(tampered, leaf_hash(lowered)))
    out = proofs(rows, "seen").withColumn("seen", F.coalesce("seen", "leaf")).withColumn("folded_root", folded("seen"))
    return out.select("doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), "root", proof_hash().alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# --- the same in SQL, levels unrolled -------------------------------------------------------------------

SQL_LEVELS = 7  # trees of up to 8 ** 7 leaves a language
# CRC-32 of an ASCII string, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1),
  lambda p: list_transform(range(0, 8), lambda b: ((ascii(substr({0}, p, 1)) >> b::INT) & 1)::BIGINT)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def _sql() -> str:
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in LEAF_COLUMNS) + ")"
    ctes = [f"""leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
      CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS seen FROM documents)""",
            """t0 AS (SELECT coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
      count(*) OVER (PARTITION BY lang) AS n, leaf AS digest FROM leaves)""",
            "f0 AS (SELECT doc_id, leaf, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, seen AS f, '' AS p FROM leaves)"]

    def levels(t: str, f: str) -> None:
        for k in range(SQL_LEVELS):
            ctes.append(f"r{t}{k} AS MATERIALIZED (SELECT g, idx // {FANOUT} AS up, max(n) AS n, list(digest ORDER BY idx) AS kids FROM {t}{k} GROUP BY g, idx // {FANOUT})")
            ctes.append(f"{t}{k + 1} AS (SELECT g, up AS idx, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest FROM r{t}{k})")
            left, right = f"array_to_string(kids[1:(f.idx % {FANOUT})::INT], '')", f"array_to_string(kids[(f.idx % {FANOUT})::INT + 2:], '')"
            ctes.append(f"""{f}{k + 1} AS (SELECT f.* REPLACE (f.idx // {FANOUT} AS idx, CASE WHEN n > 1 THEN sha256({left} || f.f || {right}) ELSE f.f END AS f,
              CASE WHEN n > 1 THEN p || {left} || {right} ELSE p END AS p) FROM {f}{k} f JOIN r{t}{k} r ON r.g = f.g AND r.up = f.idx // {FANOUT})""")

    levels("t", "f")
    ctes.append(f"u0 AS (SELECT 'top' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, digest, g AS lang FROM t{SQL_LEVELS})")
    ctes.append(f"h0 AS (SELECT doc_id, leaf, u0.digest AS subroot, u0.g AS g, u0.idx, f, p FROM f{SQL_LEVELS} x JOIN u0 ON u0.lang = x.g)")
    levels("u", "h")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(p) AS proof_sha256, f AS folded_root, f = digest AS verified
FROM h{SQL_LEVELS}, (SELECT digest FROM u{SQL_LEVELS}) top"""


SQL = _sql()
