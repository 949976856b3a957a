"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text holds every way to cut it into pieces of the vocabulary.  A
piece's weight is ``p ** ALPHA``, where p follows Zipf's law in the piece's rank (a
BPE vocabulary records merge ranks, not probabilities).  Forward filtering sums the
weights of all paths to each position; backward sampling starts at the end and
draws the last piece in proportion to the paths through it, again and again, which
yields every segmentation with exactly its probability.

A lattice falls apart at borders that no piece crosses: between words, and between
neighbouring characters that stand side by side in no piece.  The parts are
filtered once and kept (bounded, one store per Python worker), and all parts of
many texts are sampled together, one piece at a time.  The draws are hashes of the
seed, the row's key, the part's number in its text and the step, so a row's
segmentation depends on nothing else: not on partitions, batches or neighbours.

Characters without a piece become their UTF-8 bytes' pieces, and so does the
space mark itself where a text holds it; hence decoding gives back every text.
Null texts have null ids and an empty text has no pieces; null keys seed like the
empty string; repeated rows get equal segmentations; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import table

MODEL = "piece_bpe_32k.model"
ALPHA = 0.5
ZIPF = 10  # added to ranks
SEED = 17
MARK, OWN_MARK = "▁", "\udc81"  # the vocabulary's space; stands for a text's own mark (no text holds lone surrogates)
MAX_NODES = 2_500_000  # lattice positions that a worker keeps
PARTS = 60_000  # parts that are sampled together
FILTERED = 60_000  # characters whose lattices are filtered together
BASE = np.uint64(0x9E3779B97F4A7C55)  # of the hash of a piece's characters
STEP = np.uint64(0x9E3779B97F4A7C15)
PART_STEP = np.uint64(0xD1B54A32D192ED03)

_stores: dict[tuple, "Lattices"] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices(dict):
    """Maps a word (what follows one space) to the numbers of its parts.

    A part's lattice has a position before each character and one at its end;
    ``end[number]`` is the latter.  Positions are numbered through all parts.  The
    edges into position ``e`` start at ``first[e]``; ``upto`` is the cumulated
    probability of drawing them, ``piece`` and ``back`` say which piece an edge is and
    which position it comes from.  Where a part starts, ``first`` is -1.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.text, self.byte = {}, [b""] * len(model), np.zeros(256, np.int32)
        for i in range(len(model)):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                weight = (1.0 / (ZIPF - model.get_score(i))) ** alpha
                self.pieces[name] = (i, weight * 8.0 ** len(name))  # the factor cancels out; it keeps sums near 1
                self.text[i] = name.replace(MARK, " ").encode()
        self.longest = max(map(len, self.pieces))
        self.inside = {name[i : i + 2] for name in self.pieces for i in range(len(name) - 1)}
        self.crossed = any(MARK in name.lstrip(MARK) for name in self.pieces)
        self.by_length = []  # of each length: hashes in order, ids, weights
        for n in range(1, self.longest + 1):
            own = [(name, *x) for name, x in self.pieces.items() if len(name) == n]
            h = np.zeros(len(own), np.uint64)
            for i in range(n):
                h = h * BASE + np.array([ord(name[i]) for name, _, _ in own], np.uint64)
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([x[1] for x in own], np.int32)[order], np.array([x[2] for x in own])[order]))
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.parts: dict[str, int] = {}
        self.pending: list[str] = []
        self.end = np.zeros(0, np.int64)
        self.first, self.upto = np.zeros(0, np.int32), np.zeros(0)
        self.piece, self.back = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __missing__(self, word: str) -> tuple[int, ...]:
        core = word.rstrip(",.")
        if len(word) - len(core) < 2 and core.isalpha() and (core == word or core[-1] + word[-1] not in self.inside):
            got = (self.part(MARK + core),) if core == word else (self.part(MARK + core), self.part(word[-1]))
        else:
            got = self.numbers(MARK + word)
        self[word] = got
        return got

    def numbers(self, marked: str) -> tuple[int, ...]:
        """The parts of a marked string, in order: cut where no piece goes across."""
        cuts = [0, *(i for i in range(1, len(marked)) if marked[i - 1 : i + 1] not in self.inside), len(marked)]
        return tuple(self.part(marked[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a)

    def part(self, s: str) -> int:
        number = self.parts.setdefault(s, len(self.parts))
        if number == len(self.end) + len(self.pending):
            self.pending.append(s)
        return number

    def settle(self) -> None:
        """Filter the lattices of the new parts, some at a time, long ones with long ones."""
        if not self.pending:
            return
        new, self.pending = self.pending, []
        order = sorted(range(len(new)), key=lambda i: len(new[i]), reverse=True)
        ends = np.zeros(len(new), np.int64)
        found = []
        a = 0
        while a < len(new):
            b = a + max(1, FILTERED // len(new[order[a]]))
            ends[order[a:b]], *arrays = self.filtered([new[i] for i in order[a:b]], sum(len(f[0]) for f in found), sum(len(f[1]) for f in found))
            found.append(arrays)
            a = b
        self.end = np.concatenate([self.end, ends])
        kept = (self.first, self.upto, self.piece, self.back)
        self.first, self.upto, self.piece, self.back = (np.concatenate([k, *n]) for k, n in zip(kept, zip(*found), strict=True))

    def filtered(self, parts: list[str], more_nodes: int, more_edges: int) -> tuple[np.ndarray, ...]:
        """End positions, ``first``, ``upto``, ``piece``, ``back`` of new parts, longest first; the latter four follow what is there."""
        base, base_edge = len(self.first) + more_nodes, len(self.upto) + more_edges
        size = np.array([len(s) for s in parts])
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, start = len(code), np.cumsum(size) - size
        of = np.repeat(np.arange(len(parts)), size)
        room = (start + size)[of] - np.arange(n)  # characters from here to the part's end
        most = min(self.longest, int(size[0]))
        ids, weight = np.full((most, n), -1, np.int32), np.zeros((most, n))  # of the piece that starts here, by length
        h = np.zeros(n, np.uint64)
        for k in range(most):
            here = np.flatnonzero(room > k)
            h[here] = h[here] * BASE + code[here + k]
            known, piece, w = self.by_length[k]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h[here]), len(known) - 1)
            hit = known[at] == h[here]
            ids[k, here[hit]], weight[k, here[hit]] = piece[at[hit]], w[at[hit]]
        # a character that is no piece is a chain of byte pieces
        raw = {c: (MARK if c == ord(OWN_MARK) else chr(c)).encode() for c in np.unique(code[ids[0] < 0]).tolist()}
        bytes_of = np.zeros(n, np.int64)
        for i in np.flatnonzero(ids[0] < 0).tolist():
            bytes_of[i] = len(raw[int(code[i])])
            ids[0, i], weight[0, i] = self.byte[raw[int(code[i])][-1]], 8.0
        extra = np.maximum(bytes_of - 1, 0)
        node_end = base + np.arange(n) + of + 1 + np.cumsum(extra)  # the position after each character
        node_start = base + start + np.arange(len(parts)) + (np.cumsum(extra) - extra)[start]
        # forward: sums[i] before character i of a part, for the last characters
        into = np.zeros((most, n))  # share of the edge of each length among those that end after this character
        before = np.ones(n)  # sum of the paths to the position before this character
        lengths = np.arange(most)
        for e in range(int(size[0])):
            on = start[: np.searchsorted(-size, -e, side="left")] + e  # parts that have a character e
            k = lengths[: e + 1, None]
            paths = weight[k, on - k] * before[on - k]
            total = paths.sum(axis=0)
            into[: len(k), on] = paths / total
            going = room[on] > 1
            before[on[going] + 1] = total[going]
            odd = going & ~((total > 1e-60) & (total < 1e60))
            if odd.any():  # only ratios among the last sums matter
                for i in on[odd].tolist():
                    a = i + 1 - min(e + 1, self.longest)
                    before[a : i + 2] /= before[i + 1]
        k, i = np.nonzero(into[::-1].T)[::-1]  # by end character, long pieces first
        k = most - 1 - k
        share = into[k, i]
        edges = np.bincount(i, minlength=n)
        at = i - k  # the edge's first character
        back = np.where(at == start[of[i]], node_start[of[i]], node_end[np.maximum(at - 1, 0)])
        through = np.cumsum(share) - (np.cumsum(share) - share)[(np.cumsum(edges) - edges)[i]]
        last = np.cumsum(edges) - 1
        through[last] = 1.0
        piece = ids[k, at]
        # a chain's positions lie just before the end of its character
        chained = np.flatnonzero(extra)
        if len(chained):
            slot = np.flatnonzero((k == 0) & (extra[i] > 0))
            origin, add = back[slot].copy(), []
            back[slot] = node_end[chained] - 1
            for c, o, e in zip(chained.tolist(), origin.tolist(), (last - edges + 1)[chained].tolist(), strict=True):
                for j, value in enumerate(raw[int(code[c])][:-1]):
                    add.append((e, self.byte[value], o if j == 0 else node_end[c] - extra[c] + j - 1))
            where = [x[0] for x in add]
            through, piece, back = (np.insert(x, where, y) for x, y in ((through, 1.0), (piece, [x[1] for x in add]), (back, [x[2] for x in add])))
        nodes = n + len(parts) + int(extra.sum())
        count = np.ones(nodes, np.int64)
        count[node_start - base], count[node_end - base] = 0, edges
        first = base_edge + np.cumsum(count) - count
        first[node_start - base] = -1
        return (node_end[start + size - 1], first.astype(np.int32), through, piece.astype(np.int32), back.astype(np.int32))

    def text_parts(self, text: str) -> list[int]:
        """The parts of a text, in order."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, OWN_MARK)
        if self.crossed or "  " in text or text[0] == " " or text[-1] == " ":
            return list(self.numbers(MARK + text.replace(" ", MARK)))
        return list(chain.from_iterable(map(self.__getitem__, text.split(" "))))

    def sample(self, ends: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the drawn pieces, part after part, and how many each part has."""
        steps, pieces, owners = [], [], []
        own, node, draw = np.arange(len(ends)), ends, seed
        count = np.zeros(len(ends), np.int64)
        while len(own):
            draw = draw + STEP
            u = (mixed(draw) >> np.uint64(11)) * 2.0**-53
            edge = self.first[node]
            late = np.flatnonzero(u >= self.upto[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.upto[edge[late]]]
            owners.append(own)
            steps.append(count[own])
            pieces.append(self.piece[edge])
            count[own] += 1
            node = self.back[edge]
            on = self.first[node] >= 0
            own, node, draw = own[on], node[on], draw[on]
        ids = np.empty(int(count.sum()), np.uint32)
        last = np.cumsum(count) - 1
        for o, s, p in zip(owners, steps, pieces, strict=True):
            ids[last[o] - s] = p
        return ids, count

    def encode(self, texts: list[str], keys: list, seed: int) -> list[bytes]:
        """Sampled ids of each text as little-endian unsigned 32-bit bytes."""
        from xxhash import xxh3_64_intdigest

        out: list[bytes] = []
        held: list[list[int]] = []
        seeds: list[int] = []
        size = 0

        def drawn() -> None:
            lengths = np.array([len(h) for h in held], np.int64)
            self.settle()
            ends = self.end[np.fromiter(chain.from_iterable(held), np.int64, int(lengths.sum()))]
            number = np.arange(len(ends)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            seeds_ = mixed(np.repeat(np.array(seeds, np.uint64), lengths) + number.astype(np.uint64) * PART_STEP)
            ids, count = self.sample(ends, seeds_)
            at = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(lengths)])] * 4
            raw = ids.astype("<u4").tobytes()
            out.extend(raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))

        for text, key in zip(texts, keys, strict=True):
            held.append(self.text_parts(text))
            seeds.append(xxh3_64_intdigest("" if key is None else str(key), seed=seed))
            size += len(held[-1])
            if size >= PARTS:
                drawn()
                held, seeds, size = [], [], 0
                if len(self.first) >= MAX_NODES:
                    self.empty()
        if held:
            drawn()
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text."""
        return b"".join(map(self.text.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))[1:]


def lattices(path: str, alpha: float = ALPHA) -> Lattices:
    """The worker's store for a model and a smoothing exponent."""
    if (path, alpha) not in _stores:
        _stores[path, alpha] = Lattices(path, alpha)
    return _stores[path, alpha]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sample_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """``(key, ids, lossless)``: sampled ids as little-endian unsigned 32-bit bytes; whether they decode to the text."""
    where = model or model_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = lattices(where, alpha)
        for batch in batches:
            known = [t.is_valid for t in batch.column(1)]
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = store.encode(texts, batch.column(0).to_pylist(), seed)
            same = [store.decode(i) == t.encode() if k else None for i, t, k in zip(ids, texts, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i if k else None for i, k in zip(ids, known)], pa.binary()),
                                              pa.array(same, pa.bool_())], [key, "ids", "lossless"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(encoded, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary, lossless boolean")


def decode_pieces(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``(key, text)`` from ids as :func:`sample_pieces` gives them."""
    where = model or model_path()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = lattices(where)
        for batch in batches:
            texts = [store.decode(i.as_py()).decode() if i.is_valid else None for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(F.col(key), F.col(ids).alias("_ids"))
    return rows.mapInArrow(decoded, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "lossless")
