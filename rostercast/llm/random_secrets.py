"""Secrets in texts: named patterns, and a battery of randomness tests for the rest.

Base spans are those of three patterns (an assignment to a telling name, an access
key, a long run of hex digits), leftmost and non-overlapping for each.

Further candidates are whole runs of ``MIN_RUN`` or more letters, digits and
``+/_-`` that no base span touches.  For each, the smallest alphabet that holds its
signs is taken as its encoding; under the hypothesis of uniform random symbols of
that alphabet it undergoes a chi-squared test of the symbol counts, a runs test
about the middle of the alphabet and a test of the serial correlation, and
Fisher's method combines the three.  A run counts as a secret if randomness is not
rejected at ``FLOOR`` and if its class (encoding and length) keeps the share of
false discoveries under ``FDR``: every candidate brings a decoy of its own length
and encoding, which undergoes the same tests and counts in the same class, and the
class's threshold is the least p at which decoys are at most that share of
candidates.  A decoy is made of the ordinary words and numbers of its text, those
outside base spans and outside every run of ``MIN_RUN`` signs, written in the
candidate's alphabet: in its case, words joined by its sign where it has signs, for
digits the numbers first and then letters by their place; what the alphabet lacks
falls out.  No two decoys of a text share a word; where its words are used up,
fixed ones follow in an order that depends on the candidate.
Counts by class and p over the whole corpus, a bounded table, set the thresholds.

Null texts count as empty and have no spans; repeated rows are judged alike; an
empty table gives an empty result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostercast.llm.common import sliced, staged, table

MIN_RUN = 20
FLOOR = 0.01
FDR = 0.01
BINS = 100  # of the combined p-value; FLOOR is an edge
KINDS = ["assign", "access", "hex", "random"]
MASK = "[SECRET]"

# The base patterns, the least lengths and the signs of each encoding.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
             UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"]

RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}")
WORD = re.compile(r"[^\W_]+")
ORDINARY = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Words for decoys of texts that have too few; their count is prime.
SPARE = ("the of and to in is that for it was on are as with they be at one have this from by had not but what all were when we there can an "
         "your which their said if do will each about how up out them then she many some so these would other into has more two like him see "
         "time could no make than first been its who now people my made over did down only way find use may water long little very after "
         "words called just where most know get through back much before go good new write our").split()
CASE = [str, str.lower, str.upper, str.upper, str.lower, str.upper, str, str, str]  # by encoding
SETS = [frozenset(e) for e in ENCODINGS]
FOREIGN = [re.compile(f"[^{re.escape(e)}]+") for e in ENCODINGS]
BY_PLACE = str.maketrans({c: DIGITS[i % 10] for x in (LOWER, UPPER) for i, c in enumerate(x)})
VALUE = np.zeros((len(ENCODINGS), 128), np.int64)
for _i, _e in enumerate(ENCODINGS):
    VALUE[_i, [ord(c) for c in _e]] = np.arange(len(_e))
_erfc = np.vectorize(math.erfc, otypes=[float])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' spans."""
    found = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    for run in RUN.finditer(text):  # a long enough key or hex run lies in such a run
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(start, end)`` of whole runs that touch no base span."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if not ((a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) or any(s < b and a < e for s, _, e in base)):
            out.append((a, b))
    return out


def ordinary_words(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """The words of a text that lie outside base spans and outside every run."""
    out, at = [], 0
    for a, b in sorted([(s, e) for s, _, e in base] + [m.span() for m in RUN.finditer(text)] + [(len(text), len(text))]):
        if a > at:
            out += [w for w in WORD.findall(text[at:a]) if ORDINARY.fullmatch(w)]
        at = max(at, b)
    return out


def written(words: list[str], kind: int, sign: str) -> str:
    """Words in the alphabet of an encoding, each followed by ``sign``."""
    if kind == 0:
        return "".join(sorted(words, key=str.isalpha)).translate(BY_PLACE)
    return FOREIGN[kind].sub("", CASE[kind](f"{sign}\0".join([*words, ""])))


class Decoys:
    """Hands out the ordinary words of a text as decoys, each word once for an encoding and sign."""

    def __init__(self, words: list[str]):
        self.words = words
        self.left: dict[tuple[int, str], list] = {}  # text and place in it

    def next(self, run: str, kind: int) -> str:
        sign = max("+/-_", key=run.count) if kind > 6 else ""
        if (kind, sign) not in self.left:
            self.left[kind, sign] = [written(self.words, kind, sign), 0]
        own = self.left[kind, sign]
        out = own[0][own[1] : own[1] + len(run)]
        own[1] += len(run)
        if len(out) < len(run):
            seed = zlib.crc32(run.encode())
            at, step = seed % len(SPARE), 1 + seed // len(SPARE) % (len(SPARE) - 1)
            spare = written([SPARE[(at + i * step) % len(SPARE)] for i in range(len(SPARE))], kind, sign)
            out += spare * ((len(run) - len(out)) // len(spare) + 1)
        return out[: len(run)]


def encoding(run: str) -> int | None:
    """The first (smallest) alphabet that holds every sign, or None for a mixture."""
    signs = set(run)
    return next((i for i, s in enumerate(SETS) if signs <= s), None)


def randomness(runs: list[str], kinds: list[int]) -> np.ndarray:
    """The combined p-value of each run under uniform random symbols of its encoding."""
    n = np.array([len(r) for r in runs], np.int64)
    m, kind = len(runs), np.array(kinds)
    own = np.repeat(np.arange(m), n)
    value = VALUE[kind[own], np.frombuffer("".join(runs).encode("ascii"), np.uint8)]
    k = np.array([len(e) for e in ENCODINGS])[kind].astype(float)
    sums = lambda x, by=own: np.bincount(by, weights=x, minlength=m)
    # chi-squared, by the cube-root approximation
    squares = (np.bincount(own * 64 + value, minlength=64 * m).reshape(m, 64).astype(float) ** 2).sum(axis=1)
    df = k - 1
    z = (((k / n * squares - n) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    p_chi = 0.5 * _erfc(z / math.sqrt(2))
    # runs above and below the middle of the alphabet
    high = value >= (k / 2)[own]
    same = own[1:] == own[:-1]
    n1 = sums(high)
    n0 = n - n1
    runs_seen = 1 + sums((high[1:] != high[:-1]) & same, own[1:])
    mean = 2 * n0 * n1 / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    p_runs = np.where((n0 == 0) | (n1 == 0), 0.5 ** (n - 1), _erfc(np.abs(runs_seen - mean) / np.sqrt(2 * var)))
    # serial correlation
    centred = value - (sums(value) / n)[own]
    power = sums(centred**2)
    r = sums(centred[1:] * centred[:-1] * same, own[1:]) / np.maximum(power, 1e-9)
    p_serial = np.where(power == 0, 0.5 ** (n - 1), _erfc(np.abs(r + 1 / n) * np.sqrt(n / 2)))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return np.exp(-half) * (1 + half + half**2 / 2)


def length_class(n: int) -> int:
    """Half octaves from ``MIN_RUN`` on, the last one open."""
    return min(int(2 * math.log2(n / MIN_RUN)), 9)


SPAN = "array<struct<start:int,kind:int,end:int>>"
TRIAL = "array<struct<start:int,end:int,class:int,bin:int,decoy:boolean>>"


def scan(batches: Iterator[pa.RecordBatch], inside: int | None = None) -> Iterator[pa.RecordBatch]:
    """Base spans and trials of every text: the second column, or the struct's field ``inside``."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    trial = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32()), ("decoy", pa.bool_())]))
    for batch in sliced(batches):
        texts = [t.as_py() or "" for t in (batch.column(1) if inside is None else batch.column(0).field(inside))]
        base = [base_spans(t) for t in texts]
        runs, kinds, of = [], [], []
        for i, t in enumerate(texts):
            found = candidates(t, base[i])
            decoys = Decoys(ordinary_words(t, base[i]) if found else [])
            for a, b in found:
                if (e := encoding(t[a:b])) is None:
                    continue
                for run, is_decoy in ((t[a:b], False), (decoys.next(t[a:b], e), True)):
                    runs.append(run)
                    kinds.append(e)
                    of.append((i, a, b, e, is_decoy))
        trials: list[list[dict]] = [[] for _ in texts]
        if runs:
            bins = np.minimum((randomness(runs, kinds) * BINS).astype(int), BINS - 1).tolist()
            for (i, a, b, e, is_decoy), p in zip(of, bins, strict=True):
                trials[i].append({"start": a, "end": b, "class": e * 10 + length_class(b - a), "bin": p, "decoy": is_decoy})
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in base], span), pa.array(trials, trial)],
            ["doc", "base", "trials"])


def thresholds(trials: DataFrame) -> dict[int, int]:
    """By class, the least bin of p that keeps the false discoveries under ``FDR``."""
    rows = (trials.select(F.explode("trials").alias("t")).groupBy("t.class", "t.bin")
            .agg(F.count_if("t.decoy").alias("decoys"), F.count_if(~F.col("t.decoy")).alias("runs")).collect())  # classes x BINS rows at most
    out = {}
    for c in {r["class"] for r in rows}:
        decoys, runs = np.zeros(BINS), np.zeros(BINS)
        for r in rows:
            if r["class"] == c:
                decoys[r["bin"]], runs[r["bin"]] = r["decoys"], r["runs"]
        over = lambda x: np.cumsum(x[::-1])[::-1]
        good = (over(decoys) <= FDR * over(runs)) & (over(runs) > 0) & (np.arange(BINS) / BINS >= FLOOR)
        if good.any():
            out[c] = int(np.flatnonzero(good)[0])
    return out


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc, spans)``: the columns ``keep`` of every row (all by default) as a struct, and its spans ``(start, kind, end)`` in order."""
    kept = list(keep or docs.columns)
    # the text travels once: inside the struct where that holds it
    inside = kept.index(text) if text in kept else None
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), *([F.col(f"`{text}`").alias("t")] if inside is None else []))
    schema = T.StructType([T.StructField("doc", row.schema["doc"].dataType), *T.StructType.fromDDL(f"base {SPAN}, trials {TRIAL}").fields])
    found = staged(row.mapInArrow(partial(scan, inside=inside), schema), "secrets")
    least = thresholds(found)
    bound: Column = F.lit(BINS)
    if least:
        pairs = [F.lit(x) for kv in sorted(least.items()) for x in kv]
        bound_map = F.create_map(*pairs)
        more = F.filter("trials", lambda t: ~t["decoy"] & (t["bin"] >= F.coalesce(F.element_at(bound_map, t["class"]), bound)))
    else:
        more = F.filter("trials", lambda t: F.lit(False))
    spans = F.array_sort(F.concat("base", F.transform(more, lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))))
    return found.select("doc", spans.alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``MASK``; all columns stay."""
    found = find_secrets(docs, text)
    place = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc, texts = batch.column(0), []
            for t, spans in zip(doc.field(place), batch.column(1), strict=True):
                t, out, at = t.as_py(), [], 0
                for s in spans.as_py() or []:
                    if s["start"] >= at:
                        out += [t[at : s["start"]], MASK]
                    at = max(at, s["end"])
                texts.append(t if not out else "".join(out) + t[at:])
            fields = [pa.array(texts, doc.field(i).type) if i == place else doc.field(i) for i in range(doc.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(doc.type))], ["doc"])

    return found.mapInArrow(mask, T.StructType([found.schema["doc"]])).select("doc.*")


def op5_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc.doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        count(3).alias("n_random"))
