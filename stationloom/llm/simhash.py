"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

A text's fingerprint has a bit where over half its shingle hashes (XXH64, seed
42) have it.  Distinct fingerprints form a binary trie; pairs of trie nodes are
traversed together, the differing bits on the way are summed up, and a pair is
pruned when the sum exceeds the budget.  The join goes over tasks by rotation:
of two fingerprints within a budget of k bits, one of k + 1 blocks of bits is
equal, so each fingerprint enters k + 1 tries, each with another block in
front, and only subtries with a leading path in common are joined (k + 1 copies
of a fingerprint, whatever the number of rows).  A subtrie of more than
``LEAF_ROWS`` rows is cut into parts, and pairs of parts are joined.  Each task
returns a spanning forest of its links, and connected components over all of
them give the groups.

``drop_near_copies`` uses the join to find candidates for a similarity of 0.8
or more of five-word shingles, and compares the candidates' shingle sets
exactly before it links them.

Defined results: a null text counts as empty; a text with fewer words than a
shingle has one shingle, the whole sequence; one with none has fingerprint 0
and links like any other; repeated rows and equal fingerprints are one group
(copies are never paired); a null key is ignored when the group's smallest key
is taken; an empty table gives an empty result; other columns are not read by
``near_duplicates``, and ``drop_near_copies`` keeps them.  Memory follows the
longest text: 64 bytes a shingle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import components, remove, stored

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: A subtrie with at most this many rows is joined with itself in one task.
LEAF_ROWS = 16_384
#: Node pairs that a task expands at once.
FRONTIER = 200_000
#: A node pair of at most this many pairs of values is compared at once.
FEW = 16


# --- fingerprints ---------------------------------------------------------


def _majority(hashes: np.ndarray, at: np.ndarray, size: np.ndarray, bitorder: str) -> np.ndarray:
    """For runs of hashes, the bits that over half of them have: uint8, 64 a run.

    Up to 255 hashes are summed with eight bits' counts in a word.
    """
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder=bitorder).view(np.uint64)
    chunks = -(-size // 255)
    ends = np.cumsum(chunks)
    starts = np.repeat(at, chunks) + 255 * (np.arange(ends[-1]) - np.repeat(ends - chunks, chunks))
    counts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
    return (2 * np.add.reduceat(counts, ends - chunks, axis=0, dtype=np.int32) > size[:, None]).astype(np.uint8)


def fingerprints_of(text: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    flat, offsets = W.flat_parts(pc.ascii_split_whitespace(pc.ascii_lower(text)), drop_empty=True)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.cast(pa.string())), " ")
    data = b"".join(joined.cast(pa.binary()).to_pylist())
    n_words = np.diff(offsets)
    # a text's words are one space apart, and the texts follow each other without one
    begin = np.cumsum(size + 1) - size - 1 - np.repeat(np.arange(len(n_words)) - np.cumsum(n_words == 0), n_words)
    starts, row = W.window_starts(offsets, width)
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    first = np.concatenate([begin[starts], begin[offsets[:-1][few]]])
    last = np.concatenate([starts + width - 1, offsets[1:][few] - 1])
    end = begin[last] + size[last] if len(last) else last
    row = np.concatenate([row, few])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(row))
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    out = np.zeros(len(n_words), np.uint64)
    if len(row):
        at = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
        many = np.diff(np.concatenate([at, [len(row)]]))
        out[row[at]] = np.packbits(_majority(hashes, at, many, "little"), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, key="doc_id", text="text", width=SHINGLE) -> DataFrame:
    """(key, fp) for each row; fp is the unsigned fingerprint's bits as a long."""
    kind = dict(docs.dtypes)[key]

    def hashed(batches):
        for batch in W.slices(batches, "hashed_text", 2 << 20):
            fp = fingerprints_of(W.text_of(batch, "hashed_text"), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("hashed_text"))
    return pair.mapInArrow(hashed, f"key {kind}, fp long")


# --- the trie self-join ---------------------------------------------------


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, root) with the connected components of the links."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        off = a != b
        u, v, a, b = u[off], v[off], a[off], b[off]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def trie_links(a, b, depth: int, used: int, budget: int, accept=None, end: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two subtries, or within one.

    ``a`` and ``b`` are sorted uint64 values of ``end`` leading bits that share
    their first ``depth`` bits each; ``used`` bits differ so far; ``b`` is None
    for a subtrie with itself.  The forest is given by places in ``a``, then
    ``b``.  ``accept`` takes the places of pairs within the budget and says
    which are links.
    """
    own = b is None
    shift = 0 if own else len(a)
    b = a if own else b
    n_values = len(a) + (0 if own else len(b))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_found = 0
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none

    def keep(x, y):
        nonlocal found, n_found
        found.append((x, y))
        n_found += len(x)
        if n_found > 4 * n_values + FRONTIER:
            found = [_forest(n_values, *map(np.concatenate, zip(*found)))]
            n_found = len(found[0][0])

    def link(x, y):
        y = y + shift
        if accept is not None and len(x):
            yes = accept(x, y)
            x, y = x[yes], y[yes]
        keep(x, y)

    stack = [(depth, np.array([[0], [len(a)], [0], [len(b)], [used]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        alo, ahi, blo, bhi, bits = pairs
        size = (ahi - alo) * (bhi - blo)
        few = size <= FEW
        if few.any():
            n = size[few]
            ends = np.cumsum(n)
            k = np.arange(ends[-1]) - np.repeat(ends - n, n)
            width = np.repeat((bhi - blo)[few], n)
            x, y = np.repeat(alo[few], n) + k // width, np.repeat(blo[few], n) + k % width
            near = np.bitwise_count(a[x] ^ b[y]) <= budget
            if own:
                near &= x < y
            link(x[near], y[near])
            alo, ahi, blo, bhi, bits = pairs[:, ~few]
        if not len(alo):
            continue
        if depth == end:  # runs of equal values
            for lo, hi, other, last in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist()):
                places = np.arange(lo, hi) if own and lo == other else np.concatenate([np.arange(lo, hi), np.arange(other, last) + shift])
                keep(*_reach(places, accept))
            continue
        bit = np.uint64(1 << (63 - depth))
        high = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - depth)) - 1))
        amid = np.searchsorted(a, (a[alo] & high) | bit)
        bmid = np.searchsorted(b, (b[blo] & high) | bit)
        same = own & (alo == blo)
        step = [
            (alo, amid, blo, bmid, bits),
            (amid, ahi, bmid, bhi, bits),
            (alo, amid, bmid, bhi, bits + 1),
            *([(amid[~same], ahi[~same], blo[~same], bmid[~same], bits[~same] + 1)]),
        ]
        pairs = np.concatenate([np.stack(s) for s in step], axis=1)
        alive = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)
        if own:
            alive &= ~((pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1))
        stack.append((depth + 1, pairs[:, alive]))
    return _forest(n_values, *map(np.concatenate, zip(*found))) if found else (none, none)


def _reach(places: np.ndarray, accept) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of ``places`` under ``accept``; without it, all are linked.

    A search from place to place: each place that is reached is compared with
    those not reached yet, so that a tight group costs little more than its
    size.
    """
    if accept is None:
        return np.repeat(places[:1], len(places) - 1), places[1:]
    u, v = [], []
    left = places
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            yes = accept(np.full(len(left), at), left)
            if yes.any():
                near = left[yes]
                u.append(np.full(len(near), at))
                v.append(near)
                todo += near.tolist()
                left = left[~yes]
    none = np.zeros(0, np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _rotated(value: F.Column, bits: int, by: int) -> F.Column:
    """The ``bits`` leading bits of a long, rotated to the left."""
    turned = F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, bits - by)) if by else value
    return turned if bits == 64 else turned.bitwiseAND(F.lit(-(1 << (64 - bits))))


def _leaf(depth: int, budget: int, end: int, sketch_bits: int | None):
    def leaf(table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        second = table.column("second").to_numpy(zero_copy_only=False)
        mixed = table.column("part")[0].as_py() != table.column("other")[0].as_py()
        order = np.lexsort((fp, second)) if mixed else np.argsort(fp, kind="stable")
        n = int((~second).sum()) if mixed else len(fp)
        fp, accept = fp[order], None
        if sketch_bits is not None:
            one, two = (table.column(c).to_numpy().view(np.uint64)[order] for c in ("sketch", "sketch2"))
            accept = lambda x, y: np.bitwise_count(one[x] ^ one[y]) + np.bitwise_count(two[x] ^ two[y]) <= sketch_bits
        u, v = trie_links(fp[:n], fp[n:] if mixed else None, depth, 0, budget, accept, end)
        return _to_smallest(table.column("item").to_numpy()[order], u, v)

    return leaf


def _to_smallest(node: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    """Links of each component to its smallest node, so that tasks that see the same component agree."""
    order = np.argsort(node, kind="stable")  # the smallest place is then the smallest node
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    u, v = _forest(len(node), place[u], place[v])
    return pa.table({"u": node[order][u], "v": node[order][v]})


def trie_join(values: DataFrame, rows: int, budget: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, bits: int = 64, sketch_bits: int | None = None) -> DataFrame:
    """Links (u, v) that connect all items at ``budget`` or fewer differing bits.

    ``values`` has longs ``item`` and ``fp`` (its ``bits`` leading bits count),
    about ``rows`` of them in each ``trie`` if it has that column; only values
    of one trie meet.  With ``sketch_bits``, the two longs ``sketch`` and
    ``sketch2`` of items must not differ in more bits altogether.
    """
    blocks = budget + 1
    width = bits // blocks
    depth = min(width, max(0, math.ceil(math.log2(max(rows, 1) / leaf_rows))))
    trie = F.col("trie") if "trie" in values.columns else F.lit(0)
    turns = F.explode(F.array(*[F.struct((trie * blocks + i).alias("trie"), _rotated(F.col("fp"), bits, i * width).alias("fp")) for i in range(blocks)])).alias("t")
    carried = [c for c in ("item", "sketch", "sketch2") if c in values.columns]
    lead = F.shiftrightunsigned("t.fp", 64 - depth) if depth else F.lit(0).cast("long")
    turned = values.select(*carried, turns).select(*carried, "t.trie", "t.fp", lead.alias("lead"))
    group = ["trie", "lead"]
    turned = stored(turned, "subtries")
    sizes = turned.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > leaf_rows).select(*group, F.ceil(F.col("n") / leaf_rows).alias("parts"))
    leaf = _leaf(depth, budget, bits, sketch_bits)
    one = F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(False).alias("second")
    some_large = not large.isEmpty()
    large = stored(large, "large-subtries") if some_large else large
    small = turned.join(large, group, "left_anti") if some_large else turned
    links = small.select("*", *one).groupBy(*group).applyInArrow(leaf, "u long, v long")
    if some_large:
        # each pair of parts meets in one task
        cut = turned.join(large, group).withColumn("own", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
        cut = cut.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        sides = F.least("own", "to").alias("part"), F.greatest("own", "to").alias("other"), (F.col("own") > F.col("to")).alias("second")
        pairs = cut.select(*turned.columns, *sides).groupBy(*group, "part", "other").applyInArrow(leaf, "u long, v long")
        links = links.union(pairs)
    links = stored(links, "links")
    remove(values.sparkSession, turned)
    return links


def near_duplicates(docs: DataFrame, key="doc_id", text="text", width=SHINGLE, budget=MAX_BITS, leaf_rows=LEAF_ROWS) -> DataFrame:
    """(key, fp, component) for each row; component is the group's smallest key."""
    marked = stored(fingerprints(docs, key, text, width), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("key").alias("least_key")), "distinct-fingerprints")
    links = trie_join(distinct.select("fp", F.col("fp").alias("item")), distinct.count(), budget, leaf_rows)
    label = components(links).select(F.col("node").alias("fp"), "label")
    grouped = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("least_key").alias("component"))
    of_fp = grouped.join(least, "label").select("fp", "component")
    return marked.join(of_fp, "fp").select("key", "fp", "component")


# --- near copies: five-word shingles --------------------------------------

COPY_SHINGLE = 5
#: Copies have at least this share of their shingles in common, as a fraction.
ALIKE = (4, 5)
#: The chance that a bit of the fingerprints of two sets with a similarity of 0.8 differs: the angle between them.
BIT_CHANCE = math.acos(2 * 0.8 / 1.8) / math.pi
COPY_BITS = 2
#: Chance to miss a pair with a similarity of just 0.8 in all tries.
MISS = 0.01
#: Of 128 further bits, so many may differ in a candidate pair: 19 on average at 0.8, with a deviation of 4.
SKETCH_BITS = 32
#: A group of candidates with at most so many shingle sets is compared in one task.
GROUP_SETS = 2048
LEADERS = 256


def copy_tries(rows: int) -> tuple[int, int]:
    """Bits of a fingerprint, and the number of fingerprints (tries), for so many rows.

    The bits grow with the logarithm of the rows, so that a fingerprint meets
    about as many others by chance whatever their number; the tries make up
    for the pairs that more bits part.
    """
    blocks = COPY_BITS + 1
    bits = min(60, max(24, blocks * math.ceil((math.log2(max(rows, 2)) + 6) / blocks)))
    found = sum(math.comb(bits, k) * BIT_CHANCE**k * (1 - BIT_CHANCE) ** (bits - k) for k in range(COPY_BITS + 1))
    return bits, math.ceil(math.log(MISS) / math.log(1 - found))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(text: pa.Array, width: int = COPY_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, each text's sorted, and their offsets."""
    codes, distinct, offsets = W.words_of(text, lower=True)
    word = np.fromiter(map(xxhash.xxh64_intdigest, distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))[codes]
    starts, row = W.window_starts(offsets, width)
    made = np.zeros(len(starts), np.uint64)
    for k in range(width):
        made = _mixed(made + word[starts + k])
    few = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < width))
    short = np.zeros(len(few), np.uint64)
    for i, r in enumerate(few.tolist()):
        for w in word[offsets[r] : offsets[r + 1]]:
            short[i : i + 1] = _mixed(short[i : i + 1] + w)
    made, row = np.concatenate([made, short]), np.concatenate([row, few])
    order = np.lexsort((made, row))
    made, row = made[order], row[order]
    new = np.ones(len(made), bool)
    new[1:] = (np.diff(made) != 0) | (np.diff(row) != 0)
    return made[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(text)))])


def set_marks(text: pa.Array, bits: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text an id of its shingle set, 128 bits of SimHash, and ``tries`` fingerprints of other bits."""
    flat, offsets = shingle_sets(text)
    data, ends = flat.tobytes(), (8 * offsets).tolist()
    item = np.fromiter((xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(ends, ends[1:])), np.uint64, len(text))
    words = 2 + -(-bits * tries // 64)
    major = np.zeros((len(text), 64 * words), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at, size = offsets[full], np.diff(offsets)[full]
        for k in range(words):
            hashed = _mixed(flat + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            major[full, 64 * k : 64 * (k + 1)] = _majority(hashed, at, size, "big")
    packed = lambda m: np.packbits(m, axis=-1).view(">u8").astype(np.uint64)
    own = major[:, 128 : 128 + bits * tries].reshape(len(text), tries, bits)
    padded = np.concatenate([own, np.zeros((len(text), tries, 64 - bits), np.uint8)], axis=2)
    return item, packed(major[:, :128]), packed(padded)[:, :, 0]


class _Sets:
    """Shingle sets in one task, compared one with many at once."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.distinct, self.codes = np.unique(flat, return_inverse=True)
        self.sizes = sizes
        self.ends = np.cumsum(sizes)
        self.mark = np.zeros(len(self.distinct), bool)

    def part(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the sets ``others`` (places) are copies of set ``i``."""
        size = self.sizes[others]
        both = np.zeros(len(others), np.int64)
        near = (ALIKE[1] * size >= ALIKE[0] * self.sizes[i]) & (ALIKE[0] * size <= ALIKE[1] * self.sizes[i])
        some = np.flatnonzero(near & (size > 0))
        if len(some):
            n = size[some]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(self.ends[others[some]] - ends, n)
            own = self.part(i)
            self.mark[own] = True
            both[some] = np.add.reduceat(self.mark[self.codes[at]], ends - n, dtype=np.int64)
            self.mark[own] = False
        whole = size + self.sizes[i] - both
        return near & (ALIKE[1] * both >= ALIKE[0] * whole)


def _sets_of(table) -> tuple[np.ndarray, _Sets]:
    shingles = table.column("shingles").combine_chunks()
    sizes = pc.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
    return table.column("item").to_numpy(), _Sets(shingles.flatten().to_numpy(zero_copy_only=False), sizes)


def _copies_within(table):
    item, sets = _sets_of(table)
    return _to_smallest(item, *_reach(np.arange(len(item)), lambda x, y: sets.alike(int(x[0]), y)))


def _copies_of_leaders(table, leaders):
    n = len(leaders)
    both = pa.concat_tables([leaders.select(["item", "shingles"]), table.select(["item", "shingles"])])
    item, sets = _sets_of(both)
    rest = np.arange(n, len(item))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(n):
        near = rest[sets.alike(i, rest)]
        u.append(np.full(len(near), i))
        v.append(near)
    return _to_smallest(item, np.concatenate(u), np.concatenate(v))


def copy_links(sets: DataFrame, group_sets: int = GROUP_SETS) -> DataFrame:
    """Links (u, v) that connect all copies within each group of ``sets`` (cluster, item, shingles).

    A group is compared in one task, or, where it has more than ``group_sets``
    sets, in parts: each part with itself; then some leaders of the group with
    every part; then every set that is still apart from the group's largest
    component with every part.  Two sets of different components are thus
    compared in any case, and a large group of true copies needs few
    comparisons.
    """
    schema = "u long, v long"
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > group_sets).select("cluster", F.ceil(F.col("n") / group_sets).cast("int").alias("parts"))
    if large.isEmpty():
        return sets.groupBy("cluster").applyInArrow(_copies_within, schema)
    large = stored(large, "large-groups")
    part = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")
    cut = stored(sets.join(large, "cluster", "left").withColumn("part", F.coalesce(part, F.lit(0))), "cut-groups")
    links = stored(cut.groupBy("cluster", "part").applyInArrow(_copies_within, schema), "part-links")
    big = cut.where("parts IS NOT NULL")

    def with_leaders(leaders: DataFrame, chunk) -> DataFrame:
        to = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        leaders = stored(leaders.select("cluster", to, chunk.cast("int").alias("chunk"), "item", "shingles"), "leaders")
        chunks = stored(leaders.select("cluster", "part", "chunk").distinct(), "chunks")
        group = ["cluster", "part", "chunk"]
        met = big.join(chunks, ["cluster", "part"]).select(*group, "item", "shingles")
        return met.groupBy(*group).cogroup(leaders.groupBy(*group)).applyInArrow(_copies_of_leaders, schema)

    first = big.groupBy("cluster", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(LEADERS)).alias("bucket"))
    first = first.agg(F.first("parts").alias("parts"), F.min_by(F.struct("item", "shingles"), "item").alias("of")).select("cluster", "parts", "of.*")
    links = stored(links.union(with_leaders(first, F.lit(0))), "leader-links")
    label = components(links)
    named = big.select("cluster", "item").join(label, F.col("item") == F.col("node"), "left").withColumn("label", F.coalesce("label", "item"))
    counts = named.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    apart = named.join(most, ["cluster", "label"], "left_anti").select("cluster", "item")
    rest = stored(big.join(apart, ["cluster", "item"], "left_semi"), "apart")
    if rest.isEmpty():
        return links
    many = rest.groupBy("cluster").agg(F.ceil(F.count("*") / group_sets).alias("chunks"))
    rest = rest.join(many, "cluster")
    return links.union(with_leaders(rest, F.pmod(F.xxhash64("item", F.lit(2)), F.col("chunks"))))


def copy_groups(docs: DataFrame, key="doc_id", text="text", leaf_rows=LEAF_ROWS, group_sets=GROUP_SETS) -> DataFrame:
    """(key, text_hash, item, label) for each row; rows of one label are near copies.

    Items are distinct shingle sets.  Candidates are items whose fingerprints
    differ in at most ``COPY_BITS`` bits in one of the tries (see
    ``copy_tries``), and their 128-bit SimHashes in at most ``SKETCH_BITS``;
    candidates with an exact similarity of 0.8 or more are linked.
    """
    kind = dict(docs.dtypes)[key]
    bits, tries = copy_tries(docs.count())

    def marked(batches):
        for batch in W.slices(batches, "marked_text", 2 << 20):
            item, sketch, fps = set_marks(W.text_of(batch, "marked_text"), bits, tries)
            long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(item) + 1) * tries, pa.int32()), long(fps.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], long(item), long(sketch[:, 0]), long(sketch[:, 1]), lists], ["key", "text_hash", "item", "sketch", "sketch2", "fps"])

    row = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("marked_text"))
    marks = stored(row.mapInArrow(marked, f"key {kind}, text_hash long, item long, sketch long, sketch2 long, fps array<long>"), "marks")
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")).alias("least")
    items = stored(marks.groupBy("item").agg(least, F.first("sketch").alias("sketch"), F.first("sketch2").alias("sketch2"), F.first("fps").alias("fps")), "items")
    n = items.count()
    values = items.select("item", "sketch", "sketch2", F.posexplode("fps").alias("trie", "fp"))
    candidates = trie_join(values, n, COPY_BITS, leaf_rows, bits, SKETCH_BITS).distinct()
    cluster = components(candidates)
    members = items.join(cluster, F.col("item") == F.col("node")).select(F.col("label").alias("cluster"), "item", "least.key", "least.text_hash")

    def shingled(batches):
        for batch in W.slices(batches, "marked_text", 2 << 20):
            flat, offsets = shingle_sets(W.text_of(batch, "marked_text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], ["cluster", "item", "shingles"])

    row = row.withColumnsRenamed({"key": "row_key", "text_hash": "row_hash"})
    texts = row.join(members, F.col("row_key").eqNullSafe(F.col("key")) & (F.col("row_hash") == F.col("text_hash")))
    sets = texts.select("cluster", "item", "marked_text").mapInArrow(shingled, "cluster long, item long, shingles array<long>")
    sets = stored(sets.groupBy("cluster", "item").agg(F.first("shingles").alias("shingles")), "sets")
    label = components(copy_links(sets, group_sets)).withColumnRenamed("node", "item")
    remove(docs.sparkSession, sets)
    named = items.select("item", "least").join(label, "item", "left").withColumn("label", F.coalesce("label", "item"))
    named = stored(named, "copy-labels")
    remove(docs.sparkSession, items)
    return marks.select("key", "text_hash", "item").join(named, "item")


def drop_near_copies(docs: DataFrame, key="doc_id", text="text", leaf_rows=LEAF_ROWS, group_sets=GROUP_SETS) -> DataFrame:
    """``docs`` with one row of each group of near copies (``copy_groups``).

    Of a group the row with the smallest key stays; a null key counts as the
    greatest, and of equal keys the text with the smaller hash stays.  Of rows
    with equal key and text one stays.  Texts without words are one group.
    """
    groups = copy_groups(docs, key, text, leaf_rows, group_sets).select("label", "least").distinct()
    kept = stored(groups.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.key").alias("kept_key"), F.col("least.text_hash").alias("kept_hash")), "kept-keys")
    hashed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("row_key"), F.xxhash64(text).alias("row_hash"))
    stay = hashed.join(kept, F.col("row_key").eqNullSafe(F.col("kept_key")) & (F.col("row_hash") == F.col("kept_hash")), "left_semi")
    return stay.dropDuplicates(["row_key", "row_hash"]).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
