"""Sampled segmentation into pieces, and lossless decoding.

Forward filtering, backward sampling over the piece lattice: for each unit the
weights of all partial segmentations are summed forward, and a segmentation is
drawn backward, each edge with its exact share.  A piece of score s weighs
``exp(theta * s)``; scores are cut off ``_unigram.UNKNOWN`` below the least
ordinary one, which is also the weight of unknown characters (spelled in bytes).

The draw at step k of unit i of a row is a hash of (row key, seed, i, k), and
edge shares are integers computed unit by unit: the result depends on nothing
but key, text, theta and seed, however rows are dealt or tasks repeated.  All
units of a slice are drawn at once in numpy.

Defined results: a null or empty text has no piece and decodes to the empty
text; repeated rows get the same pieces; a null key counts as the key "None";
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _unigram as U
from . import _words as W

MODEL = "piece_bpe_32k.model"
THETA = 0.0003
SEED = 7
ONE = 1 << 30  # the shares of a node's edges sum up to this
BLANK = -1e8  # scores below this mark runs of U+2581 in the file
#: Edges (16 bytes each) of plain units that a process keeps, and other units whose edges it keeps.
KEPT_EDGES, CACHED_UNITS = 5_000_000, 40_000
#: Bytes of text whose lattices are in memory at once: a lattice takes some 100 times its text.
SLICE = 1 << 18
_lattices: dict[tuple, Lattice] = {}
W.FORGET["pieces"] = _lattices.clear


class Lattice:
    """Makes units' edges: rows (share, start, piece, end), by end and start.

    ``share`` is cumulative within an end; ``piece`` is -1 - code point for an
    unknown character.
    """

    def __init__(self, path: str, theta: float):
        self.vocab = vocab = U.vocabulary(path)
        scores = [score for _, score, _ in vocab.matcher.values()]
        self.floor = min(s for s in scores if s > BLANK) - U.UNKNOWN
        self.theta = theta
        self.matcher = ahocorasick.Automaton()
        self.weight = np.zeros(len(vocab.spell))
        self.size = np.zeros(len(vocab.spell), np.int64)
        for piece, (i, score, size) in vocab.matcher.items():
            self.matcher.add_word(piece, i)
            self.weight[i] = math.exp(theta * max(score, self.floor))
            self.size[i] = size
        self.matcher.make_automaton()
        self.slow = U.UnitCache(self._by_logs, CACHED_UNITS)
        self.kept: dict[str, int] = {}
        self.kept_edges = np.empty((4, KEPT_EDGES), np.int32)
        self.kept_ends = np.zeros(KEPT_EDGES + 1, np.int32)  # a unit has an edge at least

    def plain(self, unit: str) -> bool:
        return len(unit) <= 60 and self.vocab.singles.issuperset(unit)

    def keep(self, units: list[str], edge: np.ndarray) -> None:
        """Remember the edges of units, given as ``edges`` returns them, while there is room."""
        lengths = np.array([len(u) + 1 for u in units], np.int64)
        begin = np.cumsum(lengths) - lengths
        unit = np.searchsorted(begin, edge[3], side="right") - 1
        ends = np.cumsum(np.bincount(unit, minlength=len(units)))
        n = len(self.kept)
        filled = int(self.kept_ends[n])
        fit = int(np.searchsorted(ends, KEPT_EDGES - filled, side="right"))
        if not fit:
            return
        edge, unit = edge[:, : ends[fit - 1]], unit[: ends[fit - 1]]
        to = self.kept_edges[:, filled : filled + len(unit)]
        to[:] = edge
        to[1] -= begin[unit].astype(np.int32)
        to[3] -= begin[unit].astype(np.int32)
        self.kept_ends[n + 1 : n + 1 + fit] = filled + ends[:fit]
        self.kept.update((u, n + i) for i, u in enumerate(units[:fit]))

    def kept_of(self, places: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The edges of kept units, the first node of each being ``base``."""
        n = self.kept_ends[places + 1] - self.kept_ends[places]
        edge = self.kept_edges[:, _ragged(self.kept_ends[places], n)].astype(np.int64)
        at = np.repeat(base, n)
        edge[1] += at
        edge[3] += at
        return edge

    def edges(self, units: list[str]) -> np.ndarray:
        """The edges of plain units, one after another; starts and ends count on, a unit taking len + 1 nodes.

        One pass of the automaton finds all matches.  Weights are then summed
        up for all units at once, by end and by the edge's place at its end, so
        that every sum is made in the same order whatever units come together.
        """
        found = np.fromiter(chain.from_iterable(self.matcher.iter("\x00".join(units))), np.int64).reshape(-1, 2)
        piece, end = found[:, 1], found[:, 0] + 1  # the mark between units makes room for a unit's first node
        start = end - self.size[piece]
        first = np.zeros(int(end[-1]) + 1 if len(end) else 1, np.int64)
        lengths = np.array([len(u) + 1 for u in units], np.int64)
        begin = np.cumsum(lengths) - lengths
        local = end - np.repeat(begin, lengths)[end]
        place = np.arange(len(end)) - np.searchsorted(end, end, side="left")
        total = np.zeros(len(first))
        total[begin] = 1.0
        share = np.empty(len(end))
        key = local * 32 + place
        order = np.argsort(key, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            ends = end[at]
            total[ends] += total[start[at]] * self.weight[piece[at]]
            share[at] = total[ends]
        return np.stack([(ONE * (share / total[end])).astype(np.int64), start, piece, end])

    def _by_logs(self, unit: str) -> np.ndarray:
        """The edges of a long unit or one with unknown characters; starts and ends within the unit."""
        total = [0.0] + [-math.inf] * len(unit)
        rows = []
        for end, edges in enumerate(self.vocab.edges(unit)):
            logs = [total[s] + self.theta * max(score, self.floor) for s, score, _ in edges]
            top = max(logs, default=-math.inf)
            if top == -math.inf:
                continue
            parts = [math.exp(x - top) for x in logs]
            whole = math.fsum(parts)
            total[end] = top + math.log(whole)
            run = 0.0
            for i, ((start, _, piece), part) in enumerate(zip(edges, parts)):
                run += part
                share = ONE if i == len(edges) - 1 else int(ONE * min(run / whole, 1.0))
                code = piece if piece >= 0 else -1 - ord(U.unknown_bytes(unit, start).decode())
                rows.append((share, start, code, end))
        return np.array(rows, np.int32).T


def _draws(seeds: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    """30 hashed bits for each (row seed, unit, step)."""
    z = seeds + unit * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(34)).astype(np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all runs, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def sample_pieces(text: pa.Array, keys: list, path: str, theta: float = THETA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and each text's count."""
    lattice = _lattices.get((path, theta))
    if lattice is None:
        lattice = _lattices[path, theta] = Lattice(path, theta)
    vocab = lattice.vocab
    codes, distinct, offsets = U.units_of(text, vocab)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(text), np.int64)
    names = distinct.to_pylist()
    sizes = np.array([len(n) for n in names], np.int64)
    kept = np.array([lattice.kept.get(n, -1) for n in names], np.int64)
    new = np.array([k < 0 and lattice.plain(n) for n, k in zip(names, kept.tolist())])
    known, fresh, rest = np.flatnonzero(kept >= 0), np.flatnonzero(new), np.flatnonzero((kept < 0) & ~new)
    order = np.concatenate([known, fresh, rest])
    base = np.empty(len(names), np.int64)  # the first node of each distinct unit
    base[order] = np.cumsum(sizes[order] + 1) - sizes[order] - 1
    edge = [lattice.kept_of(kept[known], base[known])]
    if len(fresh):
        units = [names[i] for i in fresh.tolist()]
        made = lattice.edges(units)
        edge.append(made + np.array([[0], [base[fresh[0]]], [0], [base[fresh[0]]]]))
        lattice.keep(units, made)
    if len(rest):
        slow = lattice.slow([names[i] for i in rest.tolist()])
        at = np.repeat(base[rest], [x.shape[1] for x in slow])
        edge.append(np.concatenate(slow, axis=1) + np.stack([0 * at, at, 0 * at, at]))
    edge = np.concatenate(edge, axis=1)
    bound = (edge[3] << 32) + edge[0]
    start, piece = edge[1], edge[2]

    row = W.rows_of(offsets)
    in_row = (np.arange(len(codes)) - offsets[:-1][row]).astype(np.uint64)
    seeds = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], np.uint64)[row]
    at, first = np.arange(len(codes)), base[codes]
    node = first + sizes[codes]
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(codes), np.int64)
    while len(at):
        pick = np.searchsorted(bound, (node << 32) + _draws(seeds[at], in_row[at], len(drawn)), side="right")
        drawn.append((at, piece[pick]))
        count[at] += 1
        left = start[pick] > first
        at, first, pick = at[left], first[left], pick[left]
        node = start[pick]
    end = np.cumsum(count)
    out = np.empty(end[-1], np.int64)
    for step, (at, ids) in enumerate(drawn):  # drawn from the back
        out[end[at] - 1 - step] = ids
    per_row = W.sums(count, offsets)
    unknown = np.flatnonzero(out < 0)
    if len(unknown):
        spelled = [[vocab.byte_ids[b] for b in chr(-1 - c).encode()] for c in out[unknown].tolist()]
        size = np.ones(len(out), np.int64)
        size[unknown] = [len(s) for s in spelled]
        row_of = np.repeat(np.arange(len(text)), per_row)
        per_row = np.bincount(row_of, size, len(text)).astype(np.int64)
        out = np.repeat(out, size)
        begin = (np.cumsum(size) - size)[unknown]
        out[_ragged(begin, size[unknown])] = [b for s in spelled for b in s]
    return out.astype(np.int32), per_row


def spell_pieces(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The UTF-8 text of each run of pieces, without the leading space."""
    spell = U.vocabulary(path).spell
    size = np.array([len(s) for s in spell])
    table = np.frombuffer(b"".join(spell), np.uint8)
    begin = np.cumsum(size) - size
    data = table[_ragged(begin[ids], size[ids])].tobytes()
    end = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(counts)].tolist()
    return [data[a + (b > a) : b] for a, b in zip([0, *end[:-1]], end)]


def encode_sampled(docs: DataFrame, path: str, key="doc_id", text="text", theta=THETA, seed=SEED) -> DataFrame:
    """(key, ids, n_pieces, text_sha256) for each row; the digest is of the source text."""
    kind = dict(docs.dtypes)[key]

    def encode(batches):
        for batch in W.slices(batches, "encoded_text", SLICE, "pieces"):
            source = W.text_of(batch, "encoded_text")
            ids, n = sample_pieces(source, batch.column(0).to_pylist(), path, theta, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
            digests = [hashlib.sha256(t).hexdigest() for t in source.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n), pa.array(digests)], ["key", "ids", "n_pieces", "text_sha256"])

    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("encoded_text"))
    return pair.mapInArrow(encode, f"key {kind}, ids array<int>, n_pieces long, text_sha256 string").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key="doc_id", ids="ids") -> DataFrame:
    """(key, text) of piece ids; null ids decode to the empty text."""
    return _decoded(encoded, path, key, ids, lambda t, n, x: [pa.array([b.decode() for b in t], pa.string())], "text string")


def decode_digests(encoded: DataFrame, path: str, key="doc_id", ids="ids") -> DataFrame:
    """(key, ids_crc32, decoded_sha256): what ``decode`` gives, as digests."""
    return _decoded(encoded, path, key, ids, _digests, "ids_crc32 long, decoded_sha256 string")


def encode_digests(docs: DataFrame, path: str, key="doc_id", text="text", theta=THETA, seed=SEED) -> DataFrame:
    """(key, n_pieces, ids_crc32, decoded_sha256, lossless) for each row.

    What ``decode_digests`` gives for the ids of ``encode_sampled``, and whether
    the decoded text is the source; the ids are decoded in the task that drew
    them and need not leave it.
    """
    kind = dict(docs.dtypes)[key]

    def check(batches):
        for batch in W.slices(batches, "encoded_text", SLICE, "pieces"):
            source = W.text_of(batch, "encoded_text")
            ids, n = sample_pieces(source, batch.column(0).to_pylist(), path, theta, seed)
            decoded = spell_pieces(ids, n, path)
            same = [a == b for a, b in zip(decoded, source.cast(pa.large_binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *_digests(decoded, n, ids), pa.array(same)], ["key", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("encoded_text"))
    schema = f"key {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return pair.mapInArrow(check, schema).withColumnRenamed("key", key)


def _digests(texts: list[bytes], counts: np.ndarray, flat: np.ndarray) -> list[pa.Array]:
    """CRC-32 of each run of ids as little-endian 32-bit integers, and SHA-256 of each text."""
    data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
    return [pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]


def _decoded(encoded: DataFrame, path, key, ids, columns, schema) -> DataFrame:
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                lists = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                made = columns(spell_pieces(flat, lists, path), lists, flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", *[c.split()[0] for c in schema.split(", ")]])

    pair = encoded.select(F.col(key).alias("key"), F.col(ids).alias("decoded_ids"))
    return pair.mapInArrow(run, f"key {dict(encoded.dtypes)[key]}, {schema}").withColumnRenamed("key", key)


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path(MODEL))


QUERIES = {"op4_piece_sampling": op4_piece_sampling}
ORACLE_SQL: dict[str, str] = {}
