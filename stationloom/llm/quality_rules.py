"""Quality rules: base counts and gradient-boosted trees over them.

``fit_quality`` trains boosted regression trees (logistic loss, histogram
splits, monotonic constraints) on a bounded sample of labelled documents; the
trees are flattened into node arrays that score whole batches at once.

Defined results: a null text has no words; a text with fewer than ``MIN_WORDS``
words, or with over half its words in repeated 3-word windows, fails the base
rules and is never kept; without usable labels the base rules decide alone;
repeated rows are judged each; ties of the score with the threshold are kept;
an empty table gives an empty result; other columns are not read by
``judge_quality`` and pass through ``filter_quality`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: The classifier is fitted on at most this many labelled documents, whatever the size of the corpus.
TRAIN_ROWS = 6000
#: Documents whose estimated chance of good quality is below this are not kept.
KEEP_AT = 0.5
#: Feature -> direction in which the score may move as the feature rises.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "top_word_share": -1,
    "distinct_share": 0,
    "short_share": 0,
    "words_a_line": 0,
    "stop_share": 0,
    "longest_word": 0,
}


# --- counts ---------------------------------------------------------------


def base_counts(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and the matrix of features."""
    codes, distinct, offsets = W.words_of(text, lower=False)
    n_words = np.diff(offsets)
    size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    marks = pc.count_substring_regex(distinct, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    row = W.rows_of(offsets)

    lines, line_offsets = W.flat_parts(pc.split_pattern(text, "\n"), drop_empty=False)
    line_codes, distinct_lines = W.coded(lines)
    worded = pc.match_substring_regex(distinct_lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line_codes]
    line_row = W.rows_of(line_offsets)
    n_lines = np.bincount(line_row[worded], minlength=len(text))
    own = np.unique(line_row[worded] * np.int64(max(len(distinct_lines), 1)) + line_codes[worded])
    n_dup = n_lines - np.bincount(own // max(len(distinct_lines), 1), minlength=len(text))

    starts, window_row = W.window_starts(offsets, 3)
    key = W.window_codes(codes, len(distinct), starts, 3)
    order = np.argsort(key, kind="stable")  # rows ascend within equal keys
    same = (np.diff(key[order]) == 0) & (np.diff(window_row[order]) == 0)
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), np.int64)
    for k in range(3):
        covered[starts[twice] + k] = 1

    pair, uses = np.unique(row * np.int64(max(len(distinct), 1)) + codes, return_counts=True)
    pair_row = pair // max(len(distinct), 1)
    top = np.zeros(len(text), np.int64)
    np.maximum.at(top, pair_row, uses)
    longest = np.zeros(len(text), np.int64)
    np.maximum.at(longest, row, size)
    counts = {
        "n_words": n_words,
        "word_chars": W.sums(size, offsets),
        "n_symbols": W.sums(marks, offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": W.sums(covered, offsets),
    }
    many = np.maximum(n_words, 1)
    features = np.column_stack(
        [
            np.log1p(n_words),
            counts["word_chars"] / many,
            counts["n_symbols"] / many,
            n_dup / np.maximum(n_lines, 1),
            counts["n_repeat_words"] / many,
            top / many,
            np.bincount(pair_row, minlength=len(text)) / many,
            W.sums((size <= 3).astype(np.int64), offsets) / many,
            n_words / np.maximum(n_lines, 1),
            W.sums((size <= 2).astype(np.int64), offsets) / many,
            np.log1p(longest),
        ]
    )
    return counts, features


# --- boosted trees --------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of the positive class for each row of ``x``."""
        total = np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                goes_left = x[inner, self.feature[at]] <= self.threshold[at]
                node[inner] = np.where(goes_left, self.left[at], self.right[at])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x, y, signs, n_trees=60, depth=3, rate=0.15, ridge=1.0, least=10, bins=48) -> Trees:
    """Boosted trees under logistic loss; ``signs`` constrain each feature's direction."""
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def weight(g, h):
        return -g / (h + ridge)

    def grow(rows, level, low, high, grad, hess):
        g, h = grad[rows].sum(), hess[rows].sum()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * float(np.clip(weight(g, h), low, high))])
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(cut) + 1))[:-1]
                wl, wr = np.clip(weight(gl, hl), low, high), np.clip(weight(g - gl, h - hl), low, high)
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                fits = (n >= least) & (len(rows) - n >= least) & (signs[f] * (wr - wl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, float(wl[k]), float(wr[k]))
        if best is not None:
            _, f, k, wl, wr = best
            middle = (wl + wr) / 2
            goes_left = binned[rows, f] <= k
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[signs[f]]
            left = grow(rows[goes_left], level + 1, *bounds[:2], grad, hess)
            right = grow(rows[~goes_left], level + 1, *bounds[2:], grad, hess)
            nodes[here][:4] = [f, float(cuts[f][k]), left, right]
        else:
            total[rows] += nodes[here][4]
        return here

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    columns = list(zip(*nodes))
    return Trees(np.array(roots), *(np.array(c, t) for c, t in zip(columns, (int, float, int, int, float))), start)


def fit_quality(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", rows=TRAIN_ROWS) -> Trees | None:
    """Fit on at most ``rows`` labelled documents, those with the smallest hashed keys.

    A bound on the hash lets through about as many keys as are wanted, so that
    hardly more than ``rows`` of them are sorted.  None if the sample has not
    both classes.  Only features reach the driver, one row of them for each
    key: of several documents with a key, the least.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("sample_key")).agg(F.max(label).cast("double").alias("sample_label"))
    hashed = F.xxhash64("sample_key")
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.where(hashed < -(1 << 63) + int(share * (1 + 6 / rows**0.5) * (1 << 64)))
    sample = known.orderBy(hashed, "sample_key").limit(rows)
    texts = docs.select(F.col(key).alias("sample_key"), F.col(text).alias("sample_text"))
    joined = texts.join(F.broadcast(sample), "sample_key").select("sample_key", "sample_label", "sample_text")
    kind = dict(docs.dtypes)[key]

    def features(batches):
        for batch in W.slices(batches, "sample_text"):
            _, x = base_counts(W.text_of(batch, "sample_text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x.tolist(), pa.list_(pa.float64()))], ["sample_key", "y", "x"])

    made = joined.mapInArrow(features, f"sample_key {kind}, y double, x array<double>")
    got = made.groupBy("sample_key").agg(F.max("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()
    y = got.column(0).to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.array(got.column(1).to_pylist())
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of the rows
    return fit_trees(x[order], y[order], list(FEATURES.values()))


# --- verdicts -------------------------------------------------------------


def _verdicts(text: pa.Array, model: Trees | None, keep_at: float) -> dict[str, np.ndarray]:
    counts, x = base_counts(text)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
    score = np.ones(len(x)) if model is None else model.score(x)
    return counts | {"base_failed": failed, "kept": ~failed & (score >= keep_at), "score": score}


def judge_quality(docs: DataFrame, model: Trees | None, key="doc_id", text="text", keep_at=KEEP_AT) -> DataFrame:
    """Key, counts, base_failed, kept and score for each row of ``docs``."""
    kind = dict(docs.dtypes)[key]

    def judge(batches):
        for batch in W.slices(batches, "judged_text"):
            found = _verdicts(W.text_of(batch, "judged_text"), model, keep_at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["judged_key", *found])

    schema = f"judged_key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    judged = docs.select(F.col(key).alias("judged_key"), F.col(text).alias("judged_text")).mapInArrow(judge, schema)
    return judged.withColumnRenamed("judged_key", key)


def filter_quality(docs: DataFrame, model: Trees | None, text="text", keep_at=KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def keep(batches):
        for batch in W.slices(batches, text):
            yield batch.filter(pa.array(_verdicts(W.text_of(batch, text), model, keep_at)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs, fit_quality(docs, labels))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
