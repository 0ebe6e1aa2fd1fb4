"""Language-model scores: a gated recurrent network with a class-factored softmax.

Counts of all training tokens give the base model and the network's symbols:
the ``SYMBOLS`` most frequent tokens, and one symbol for each shape of the
other words, within which a word has its share of the counts.  The network is
trained on every training document by truncated backpropagation in numpy:
documents are dealt by a hash of key and text into ``ROUNDS`` rounds and, in
each, into shards of about ``SHARD_TOKENS`` tokens; a task trains on a shard
from the model of the round before, and the shards' weights are averaged in a
tree.  Shards and their order depend on nothing but the rows, so the model does
not depend on how the table is cut into tasks.  Scoring carries the state
through each whole document, window by window, and adds up the log-likelihood
of all its tokens.

The counts of about the ``HEAD`` most frequent words go to the scoring tasks;
rarer words meet their counts in a join, so nothing that grows with the
vocabulary is collected.

Defined results: a null or empty text has the end token alone; a null key is
hashed as the empty text; a key held out is never learnt from; without training
documents the score is the base score; repeated rows are learnt from and scored
each; ties between equally frequent words go to the smaller word, or, where the
head ends among them, to the smaller hash; an empty table gives an empty
result; other columns are not read.  A document longer than a lane of a slice
is learnt from in pieces, each from an empty state.
"""

from __future__ import annotations

import ctypes
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import remove, stored

SYMBOLS = 1200
HEAD = 300_000
CLASSES = 32
HIDDEN = 16
WINDOW = 16
LANES = 256
ROUNDS = 3
SHARD_TOKENS = 1_200_000
RATE = 0.01
#: Bytes of text that are learnt from, or scored, at once.
LEARN_BYTES, SCORE_BYTES = 6 << 20, 6 << 20
#: Weight vectors that one task averages.
FAN_IN = 64
END = ""  # stands for the end token; no word is empty
N_SHAPES = 16
LN10 = math.log(10)


def word_shapes(words: pa.Array) -> np.ndarray:
    """0..15: non-ASCII, final punctuation, and length."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = (pc.binary_length(words).to_numpy(zero_copy_only=False) > size).astype(np.int64)
    final = pc.match_substring_regex(words, r"[^\pL\pN]$").to_numpy(zero_copy_only=False).astype(np.int64)
    return wide * 8 + final * 4 + np.clip((size - 1) // 4, 0, 3)


# --- the network ----------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """The classes of the symbols: most frequent first, of about equal mass of square roots."""

    class_of: np.ndarray
    place: np.ndarray  # within the class
    bounds: np.ndarray  # the symbols of class c are bounds[c] .. bounds[c + 1]

    @classmethod
    def of(cls, counts: np.ndarray) -> Layout:
        mass = np.cumsum(np.sqrt(counts + 1.0))
        class_of = np.minimum((mass - mass[0]) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        class_of = np.unique(class_of, return_inverse=True)[1]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(class_of))])
        return cls(class_of, np.arange(len(counts)) - bounds[class_of], bounds)


def initial_weights(counts: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
    """Weights under which every token has its share of ``counts``, whatever the state."""
    rng = np.random.default_rng(5)
    n, classes = len(counts), len(layout.bounds) - 1
    share = counts + 0.5
    of_class = np.add.reduceat(share, layout.bounds[:-1])
    return {
        "x": rng.normal(0, 0.3, (n, 3 * HIDDEN)).astype(np.float32),
        "u": rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "wc": np.zeros((HIDDEN, classes), np.float32),
        "bc": np.log(of_class / of_class.sum()).astype(np.float32),
        "wv": np.zeros((n, HIDDEN), np.float32),
        "bv": np.log(share / of_class[layout.class_of]).astype(np.float32),
    }


def _step(w, before, h):
    """The gates and the next state."""
    a, s = w["x"][before], h @ w["u"]
    zr = a[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
    np.negative(zr, zr)
    np.exp(zr, zr)
    zr += 1
    np.reciprocal(zr, zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    sn = s[:, 2 * HIDDEN :]
    n = r * sn
    n += a[:, 2 * HIDDEN :]
    np.tanh(n, n)
    new = h - n
    new *= z
    new += n
    return z, r, sn, n, new


def _chosen(logits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log of the softmax share of one place in each column of ``logits``, which are overwritten."""
    logits -= logits.max(axis=0)
    out = logits[place, np.arange(len(place))]
    np.exp(logits, out=logits)
    return out - np.log(logits.sum(axis=0))


def _off_by(logits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The softmax of each column less one at its place: the loss's derivative; overwrites ``logits``."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    logits[place, np.arange(len(place))] -= 1
    return logits


def _by_class(layout: Layout, target: np.ndarray):
    """An order of the targets by class, and (class, from, to) in that order for the classes that occur."""
    of = layout.class_of[target]
    order = np.argsort(of, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(of[order])) + 1).tolist(), len(of)]
    return order, [(int(of[order[i]]), i, j) for i, j in zip(cuts, cuts[1:]) if j > i]


def log_chances(w, layout: Layout, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability in its state."""
    order, classes = _by_class(layout, target)
    state, place, within = np.ascontiguousarray(h[order].T), layout.place[target[order]], np.zeros(len(order), h.dtype)
    for c, i, j in classes:
        a, b = layout.bounds[c], layout.bounds[c + 1]
        if b - a > 1:
            within[i:j] = _chosen(w["wv"][a:b] @ state[:, i:j] + w["bv"][a:b, None], place[i:j])
    within += _chosen(w["wc"].T @ state + w["bc"][:, None], layout.class_of[target[order]])
    out = np.empty_like(within)
    out[order] = within
    return out


def _gradients(w, layout: Layout, before, target, fresh, h0, live=None):
    """Gradients of the mean loss over a window (steps x lanes), and the last state.

    ``fresh`` marks the first token of a document, where the state is zero;
    ``live`` the steps of lanes that have not ended, which alone have a loss.
    """
    steps, lanes = target.shape
    kind = w["u"].dtype
    hs, zs, rs, sns, ns, states = (np.empty((steps, lanes, HIDDEN), kind) for _ in range(6))
    h, new_there = h0, fresh.any(axis=1)
    for t in range(steps):
        hs[t] = h
        if new_there[t]:
            hs[t, fresh[t]] = 0
        zs[t], rs[t], sns[t], ns[t], states[t] = _step(w, before[t], hs[t])
        h = states[t]
    flat, goal = states.reshape(-1, HIDDEN), target.ravel()
    g = {k: np.zeros_like(v) for k, v in w.items()}
    live = np.ones(len(goal), bool) if live is None else live.ravel()
    order, classes = _by_class(layout, goal)
    state, place = np.ascontiguousarray(flat[order].T), layout.place[goal[order]]
    share = (live[order] / np.float32(live.sum())).astype(np.float32)
    d = _off_by(w["wc"].T @ state + w["bc"][:, None], layout.class_of[goal[order]])
    d *= share
    g["wc"], g["bc"] = state @ d.T, d.sum(axis=1)
    own = w["wc"] @ d
    for c, i, j in classes:
        a, b = layout.bounds[c], layout.bounds[c + 1]
        if b - a > 1:
            d = _off_by(w["wv"][a:b] @ state[:, i:j] + w["bv"][a:b, None], place[i:j])
            d *= share[i:j]
            g["wv"][a:b], g["bv"][a:b] = d @ state[:, i:j].T, d.sum(axis=1)
            own[:, i:j] += w["wv"][a:b].T @ d
    dh = np.empty_like(flat)
    dh[order] = own.T
    dh = dh.reshape(steps, lanes, HIDDEN)
    to_z, to_n, to_r = (hs - ns) * zs * (1 - zs), (1 - zs) * (1 - ns * ns), sns * rs * (1 - rs)
    da, ds = (np.empty((steps, lanes, 3 * HIDDEN), kind) for _ in range(2))
    back = np.zeros((lanes, HIDDEN), kind)
    turned = np.ascontiguousarray(w["u"].T)
    for t in reversed(range(steps)):
        d = dh[t] + back
        dn = d * to_n[t]
        np.multiply(d, to_z[t], out=da[t, :, :HIDDEN])
        np.multiply(dn, to_r[t], out=da[t, :, HIDDEN : 2 * HIDDEN])
        da[t, :, 2 * HIDDEN :] = dn
        ds[t, :, : 2 * HIDDEN] = da[t, :, : 2 * HIDDEN]
        np.multiply(dn, rs[t], out=ds[t, :, 2 * HIDDEN :])
        back = ds[t] @ turned
        back += d * zs[t]
        if new_there[t]:
            back[fresh[t]] = 0
    g["u"] = hs.reshape(-1, HIDDEN).T @ ds.reshape(-1, 3 * HIDDEN)
    da, seen = da.reshape(-1, 3 * HIDDEN), before.ravel()
    order = np.argsort(seen, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(seen[order]) > 0]))
    g["x"][seen[order][first]] = np.add.reduceat(da[order], first, axis=0)
    return g, states[-1]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _lanes(offsets: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all tokens lane by lane, and the lanes' ends.

    Whole documents, the longest first, go to the shortest lane; those longer
    than a lane's share go in pieces of that length.
    """
    most = -(-int(offsets[-1]) // lanes)
    size = np.diff(offsets)
    pieces = -(-size // most)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(offsets[:-1], pieces) + within * most
    size = np.minimum(most, np.repeat(offsets[1:], pieces) - start)
    order = np.argsort(-size, kind="stable")
    heap = [(0, i) for i in range(lanes)]
    lane = np.empty(len(size), np.int64)
    for i, n in zip(order.tolist(), size[order].tolist()):
        total, at = heap[0]
        lane[i] = at
        heapq.heapreplace(heap, (total + n, at))
    order = np.argsort(lane, kind="stable")
    return _ragged(start[order], size[order]), np.cumsum(np.bincount(lane, size, lanes).astype(np.int64))


class Trainer:
    """Adam over windows of lanes; the state runs on from window to window."""

    def __init__(self, weights, layout: Layout, end: int):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.layout, self.end, self.steps, self.tokens = layout, end, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def learn(self, tokens: np.ndarray, offsets: np.ndarray) -> None:
        """One pass over documents, the tokens of document i being offsets[i] .. offsets[i + 1]."""
        if not len(tokens):
            return
        lanes = max(1, min(LANES, len(tokens) // (4 * WINDOW)))
        before = np.concatenate([[self.end], tokens[:-1]])
        before[offsets[:-1]] = self.end
        places, ends = _lanes(offsets, lanes)
        # a state is empty where the place does not follow the one before
        fresh = np.concatenate([[True], np.diff(places) != 1])
        fresh[np.isin(places, offsets[:-1])] = True
        before, tokens = before[places], tokens[places]
        first = np.concatenate([[0], ends[:-1]])
        fresh[first[first < len(fresh)]] = True
        order = np.argsort(first - ends, kind="stable")  # the longest lanes first: those that have ended stand last
        first, size = first[order], (ends - first)[order]
        h = np.zeros((lanes, HIDDEN), np.float32)
        length = int(size.max())
        for steps in np.array_split(np.arange(length), -(-length // WINDOW)):
            some = int(np.searchsorted(-size, -steps[0], side="left"))
            at = first[:some] + steps[:, None]
            live = steps[:, None] < size[:some]
            at = np.where(live, at, 0)  # a lane that ends in the window stands at any token, without a loss
            g, h = _gradients(self.w, self.layout, before[at], tokens[at], fresh[at], h[:some], live)
            self._adam(g)
            self.tokens += int(live.sum())

    def _adam(self, g) -> None:
        self.steps += 1
        rate = RATE * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps) / math.sqrt(1 + self.steps / 200)
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.01 * (grad * grad - self.v[k])
            self.w[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)


def document_scores(w, layout: Layout, tokens: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """Natural log-likelihood of each whole document."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], offsets[:-1][order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    before = np.full(len(order), end)
    states, goals, rows, held = [], [], [], 0

    def settle():
        got = log_chances(w, layout, np.concatenate(states), np.concatenate(goals))
        np.add.at(total, np.concatenate(rows), got)

    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))  # documents with more than t tokens
        *_, h = _step(w, before[:live], h[:live])
        goal = tokens[start[:live] + t]
        states.append(h)
        goals.append(goal)
        rows.append(np.arange(live))
        before = goal
        held += live
        if held > 100_000:
            settle()
            states, goals, rows, held = [], [], [], 0
    if held:
        settle()
    out = np.empty(len(order))
    out[order] = total
    return out


# --- the corpus -----------------------------------------------------------


def _give_back() -> None:
    """Return what the process holds without using it, Arrow's memory and, where the C library can, numpy's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tidy(work):
    """``work`` over batches; a process that waits for its next task then holds nothing of the last one."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def _count_words(batches):
    for batch in W.slices(batches, "lm_text"):
        codes, distinct, _ = W.words_of(W.text_of(batch, "lm_text"), lower=True)
        words = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])])
        n = np.append(np.bincount(codes, minlength=len(distinct)), batch.num_rows)
        yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])


def _shaped(batches):
    for batch in batches:
        shape = word_shapes(batch.column(0).cast(pa.large_string()))
        yield pa.RecordBatch.from_arrays([pa.array(shape.astype(np.int32)), batch.column(1)], ["shape", "c"])


@dataclass(frozen=True)
class Vocabulary:
    words: pa.Array  # the head, by rank
    counts: np.ndarray  # of the head
    n_symbols: int  # the first words of the head are symbols; shapes come behind them
    end: int
    layout: Layout
    shape_mass: np.ndarray  # counts of the words of each shape that are no symbols

    def symbols_of(self, distinct: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and rank among ``words`` (-1: rarer), the head or its first words, of each distinct word."""
        rank = pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbol, other = rank.copy(), np.flatnonzero((rank < 0) | (rank >= self.n_symbols))
        symbol[other] = self.n_symbols + word_shapes(distinct.take(pa.array(other)))
        return symbol, rank

    def documents(self, text: pa.Array, words: pa.Array | None = None):
        """Word codes, distinct words, word offsets, ranks; symbols with ends, and their offsets."""
        codes, distinct, offsets = W.words_of(text, lower=True)
        symbol, rank = self.symbols_of(distinct, self.words if words is None else words)
        ends = offsets + np.arange(len(offsets))
        tokens = np.full(int(ends[-1]), self.end)
        tokens[np.arange(len(codes)) + W.rows_of(offsets)] = symbol[codes] if len(codes) else codes
        return codes, distinct, offsets, rank, tokens, ends


def _shard_slices(batches, most: int):
    """(shard, texts) of rows (shard, lm_text) in order, cut by shard and size alone, whatever the batches."""
    held, size, shard = [], 0, None
    for batch in batches:
        shards = batch.column(0).to_pylist()
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = 0
        for i, (now, n) in enumerate(zip(shards, sizes)):
            if now != shard or (size and size + n > most):
                held.append(batch.column(1).slice(start, i - start))
                if sum(map(len, held)):
                    yield shard, pa.concat_arrays(held)
                held, size, start, shard = [], 0, i, now
            size += n
        held.append(batch.column(1).slice(start))
    if sum(map(len, held)):
        yield shard, pa.concat_arrays(held)


def _fit(docs: DataFrame, vocab: Vocabulary, weights, n_tokens: int) -> dict[str, np.ndarray]:
    """Train over all rows of ``docs``: (lm_hash, lm_key, lm_text), ``n_tokens`` tokens altogether."""
    spark = docs.sparkSession
    names = list(weights)
    shapes = [weights[k].shape for k in names]
    sizes = np.cumsum([weights[k].size for k in names])[:-1]
    schema = "task long, tokens long, weights binary"

    def average(table):
        table = table.sort_by("task")  # sums do not depend on the order in which rows come
        n = table.column("tokens").to_numpy().astype(float)
        flat = np.array([np.frombuffer(b, np.float32) for b in table.column("weights").to_pylist()], float)
        mean = (flat * n[:, None]).sum(axis=0) / n.sum()
        return pa.table({"task": table.column("task").slice(0, 1), "tokens": pa.array([int(n.sum())]), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    symbols = vocab.words.slice(0, vocab.n_symbols)
    shards = max(1, round(n_tokens / ROUNDS / SHARD_TOKENS))
    dealt = F.pmod(F.col("lm_hash"), F.lit(ROUNDS * shards))
    learnt = 0
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((Vocabulary(symbols, vocab.counts[: len(symbols)], vocab.n_symbols, vocab.end, vocab.layout, vocab.shape_mass), weights))

        def train(batches, shared=shared):
            vocab, weights = shared.value
            trainer, at = None, None

            def done():
                flat = np.concatenate([trainer.w[n].ravel() for n in names])
                row = [pa.array([at], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(row, ["task", "tokens", "weights"])

            for shard, text in _shard_slices(batches, LEARN_BYTES):
                if trainer is None or shard != at:
                    if trainer is not None:
                        yield done()
                    trainer, at = Trainer(weights, vocab.layout, vocab.end), shard
                *_, tokens, ends = vocab.documents(W.whole(text))
                trainer.learn(tokens, ends)
            if trainer is not None:
                yield done()

        part = docs.withColumn("dealt", dealt).where(F.col("dealt") % ROUNDS == k).withColumn("shard", F.floor(F.col("dealt") / ROUNDS))
        part = part.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "lm_hash", "lm_key", "lm_text")
        made = stored(part.select("shard", "lm_text").mapInArrow(_tidy(train), schema), "weights")
        n, tokens = made.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        learnt += tokens
        while n > 1:  # about FAN_IN rows in a group
            groups = -(-n // FAN_IN)
            last = made
            made = stored(last.groupBy(F.pmod("task", F.lit(groups)).alias("group")).applyInArrow(average, schema), "weights")
            remove(spark, last)
            n = made.count()
        if n:
            flat = np.frombuffer(bytes(made.first()["weights"]), np.float32)
            weights = {name: part.reshape(shape) for name, part, shape in zip(names, np.split(flat, sizes), shapes)}
        remove(spark, made)
        shared.unpersist()
    if learnt != n_tokens:
        raise RuntimeError(f"{learnt} tokens were learnt from, not {n_tokens}")
    return weights


def _head(counts: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words, ``HEAD`` at most, by count and then by word, and their counts.

    A histogram of the counts in sixteenths of powers of two tells down to
    which bin all words fit; of the next bin, words with small hashes fill up
    the rest, as a histogram of 1024 hash buckets allows.
    """
    kind = F.floor(F.log2("c") * 16)
    bins = counts.groupBy(kind.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()  # under a thousand rows
    total, least = 0, 0
    wanted = F.lit(True)
    for r in bins:
        if total + r["n"] > HEAD:
            least = r["bin"]
            bucket = F.pmod(F.xxhash64("word"), F.lit(1024))
            sizes = {b["bucket"]: b["n"] for b in counts.where(kind == least).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}
            fit = 0
            while total + sizes.get(fit, 0) <= HEAD:
                total += sizes.get(fit, 0)
                fit += 1
            wanted = (kind > least) | ((kind == least) & (bucket < fit))
            break
        total += r["n"]
    table = counts.where(wanted).select("word", "c").toArrow()
    order = pc.sort_indices(table, sort_keys=[("c", "descending"), ("word", "ascending")])
    table = table.take(order).combine_chunks()
    words = table.column("word").cast(pa.large_string())
    return (words.chunk(0) if words.num_chunks else pa.array([], pa.large_string())), table.column("c").to_numpy().astype(float)


SCORED = ["doc_row", "word", "n", "key", "held_out", "n_tokens", "n_known", "logs", "score"]


def _scored(batches, vocab: Vocabulary, w):
    """Rows ``SCORED``: one for each document of (doc_row, key, held_out, lm_text), and one for each of its rare words."""
    logs = np.log10(vocab.counts + 0.5)
    shape_logs = np.log10(vocab.shape_mass)
    end_rank = pc.index(vocab.words, END).as_py()
    for batch in W.slices(batches, "lm_text", SCORE_BYTES):
        codes, distinct, offsets, rank, tokens, ends = vocab.documents(W.text_of(batch, "lm_text"))
        _give_back()  # cutting words takes several times the text
        row = W.rows_of(offsets)
        n_docs = batch.num_rows
        in_head = rank[codes] >= 0 if len(codes) else np.zeros(0, bool)
        head_rank = rank[codes[in_head]]
        known = np.bincount(row[in_head], minlength=n_docs) + (end_rank >= 0)
        log_sum = np.bincount(row[in_head], logs[head_rank], n_docs) + (logs[end_rank] if end_rank >= 0 else math.log10(0.5))
        # the network gives a symbol; a word that is none has its share of its shape
        nn = document_scores(w, vocab.layout, tokens, ends, vocab.end) / LN10
        is_symbol = in_head.copy()
        is_symbol[in_head] = head_rank < vocab.n_symbols
        nn -= np.bincount(row[is_symbol], logs[rank[codes[is_symbol]]], n_docs) + (logs[end_rank] if end_rank >= 0 else math.log10(0.5))
        other = np.flatnonzero(~is_symbol)
        shape = tokens[other + row[other]] - vocab.n_symbols
        nn -= np.bincount(row[other], shape_logs[shape] if len(shape) else None, n_docs)
        pair, uses = np.unique(row[~in_head] * np.int64(max(len(distinct), 1)) + codes[~in_head], return_counts=True)
        rare_row, rare_code = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
        ids = batch.column(0)
        n_rare = len(pair)
        null = lambda kind: pa.nulls(n_rare, kind)
        own = pa.array([f" {i}" for i in ids.to_pylist()], pa.string())  # meets no word, and no other row
        columns = [
            pa.concat_arrays([ids, ids.take(pa.array(rare_row))]),
            pa.concat_arrays([own, distinct.take(pa.array(rare_code)).cast(pa.string())]),
            pa.array(np.concatenate([np.zeros(n_docs, np.int64), uses]), pa.int64()),
            pa.concat_arrays([batch.column(1), null(batch.column(1).type)]),
            pa.concat_arrays([batch.column(2), null(pa.bool_())]),
            pa.concat_arrays([pa.array(np.diff(ends), pa.int64()), null(pa.int64())]),
            pa.concat_arrays([pa.array(known.astype(np.int64)), null(pa.int64())]),
            pa.concat_arrays([pa.array(log_sum), null(pa.float64())]),
            pa.concat_arrays([pa.array(nn), null(pa.float64())]),
        ]
        yield pa.RecordBatch.from_arrays(columns, SCORED)


def score_documents(docs: DataFrame, held_out, key="doc_id", text="text") -> DataFrame:
    """Scores of each row; learns from the rows where the column ``held_out`` is false.

    Columns: key, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("lm_text"))
    as_text = F.col("key").cast("string")
    training = base.where(~F.col("held_out")).select(F.xxhash64(as_text, "lm_text").alias("lm_hash"), as_text.alias("lm_key"), "lm_text")
    counts = training.select("lm_text").mapInArrow(_tidy(_count_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    counts = stored(counts, "word-counts")
    n_all, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, head_counts = _head(counts)
    n_symbols = min(SYMBOLS, len(words))
    place = pc.index(words, END).as_py()
    if n_all and not 0 <= place < n_symbols:
        # the end token is a symbol however rare it is: the last one
        end_count = counts.where(F.col("word") == END).first()["c"]
        rest = np.flatnonzero(np.arange(len(words)) != place)
        at = max(n_symbols - 1, 0)
        words = pa.concat_arrays([words.take(pa.array(rest[:at])), pa.array([END], pa.large_string()), words.take(pa.array(rest[at:]))])
        head_counts = np.concatenate([head_counts[rest[:at]], [end_count], head_counts[rest[at:]]])
    masses = np.zeros(N_SHAPES)
    for r in counts.mapInArrow(_shaped, "shape int, c long").groupBy("shape").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        masses[r["shape"]] = r["m"]
    symbol_counts = head_counts[:n_symbols]
    if n_symbols:
        masses -= np.bincount(word_shapes(words.slice(0, n_symbols)), symbol_counts + 0.5, N_SHAPES)
    masses = np.maximum(masses, 0) + 0.5
    all_counts = np.concatenate([symbol_counts, masses])
    layout = Layout.of(all_counts)
    vocab = Vocabulary(words, head_counts, n_symbols, max(pc.index(words, END).as_py(), 0), layout, masses)
    weights = initial_weights(all_counts, layout)
    if n_all:
        weights = _fit(training, vocab, weights, n_all)
    shared = spark.sparkContext.broadcast((vocab, weights))
    numbered = base.select(F.monotonically_increasing_id().alias("doc_row"), "key", "held_out", "lm_text")
    schema = f"doc_row long, word string, n long, key {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    # words meet by 128 bits of hash: longs are sorted and compared faster than words
    hashed = [F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(1), "word").alias("h2")]
    rows = numbered.mapInArrow(_tidy(lambda batches: _scored(batches, *shared.value)), schema)
    met = rows.select(*hashed, *[c for c in SCORED if c != "word"]).join(counts.select(*hashed, "c"), ["h1", "h2"], "left")
    rare = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    total = math.log10(n_all + 0.5 * (n_types + 1))
    done = met.groupBy("doc_row").agg(
        F.max("key").alias("key"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(rare), F.lit(0.0))).alias("logs"), F.max("score").alias("nn"),
    )
    score_col = F.col("nn") + F.col("logs") if n_all else F.col("base_score")
    out = done.withColumn("train_tokens", F.lit(n_all).cast("long")).withColumn("base_score", F.col("logs") - F.col("n_tokens") * total)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score_col.alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(docs, held_out)


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
