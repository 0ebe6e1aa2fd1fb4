"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are the indexed documents and training passages the queries.  Long
items are indexed in parts of ``PART_WORDS`` words, half a part apart or less,
the last one at the item's end, so that a quote as long as a part covers three
quarters of one; passages are windows of twice the longest part, half a window
apart, so that each part a document quotes lies whole in one of them.  A term's impact on a part is its
BM25 weight divided by the part's weight against itself, so one threshold fits
all parts.

All passages of a slice are bounded at once by the block maxima of their terms;
those that may reach the threshold in some block go through block-max WAND,
which returns every part at or above it.  A hit counts if the passage also
holds enough of the part's word n-grams (its question) and, where the item has
an answer, enough of the answer's words, there or as many words behind the
passage as the answer has.

A benchmark of more than ``ITEMS_AT_ONCE`` items or ``BYTES_AT_ONCE`` bytes is
indexed in several rounds, each searched by all passages.  The number and mean
length of the parts, the holders of each term and the window are those of the
whole benchmark in every round, so results do not depend on the rounds.

Defined results: null and empty texts and items match nothing, nor does an
item with a null id; an id may be of any type; an item of fewer words than an
n-gram has one gram, its words; of repeated items and rows each row is judged,
and an id is found once a row, with its best hit; equal scores are all
returned; an empty table or benchmark finds nothing; other columns are not read
by ``find_leaks`` and pass through ``drop_leaks`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _words as W
from ._shared import stored

K1, B = 1.2, 0.75
THRESHOLD = 0.6
GRAM = 5
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.6
PART_WORDS = 128
BLOCK = 4  # parts in a block of a posting list
#: At most so many items, and bytes of them, are indexed at once (an index takes some 60 times its text); more go in several rounds.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 4 << 20


def terms_of(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct terms and offsets: lower-cased runs of letters and digits."""
    plain = pc.replace_substring_regex(pc.utf8_lower(text), r"[^\pL\pN]+", " ")
    return W.words_of(plain, lower=False)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is what follows the last question mark, if anything does."""
    head, mark, tail = text.rpartition("?")
    return (head + mark, tail) if mark and tail.strip() else (text, "")


@dataclass
class Index:
    items: list  # of each part
    parts: list[list[int]]  # its terms, in order
    answers: list[frozenset[int]]
    grams: list[frozenset[tuple[int, ...]]]
    terms: dict[str, int]
    postings: list[list[tuple[int, float]]]  # of each term: (part, impact) by part
    blocks: list[dict[int, float]]  # of each term: block -> greatest impact
    tops: list[float]
    block_start: np.ndarray  # CSR over terms of (block, greatest impact)
    block_of: np.ndarray
    block_max: np.ndarray
    n_blocks: int
    window: int
    reach: list[int]  # words of each part's answer


@dataclass(frozen=True)
class Statistics:
    """What an index must know of the whole benchmark."""

    parts: int
    mean: float  # words of a part
    longest: int
    holders: dict[str, int]  # parts that hold each term


def part_starts(n_words: int) -> list[int]:
    """Where the parts of an item of so many words begin."""
    final = max(n_words - PART_WORDS, 0)
    return [*range(0, final, PART_WORDS // 2), final] if n_words else []


def count_parts(items: list[str]) -> Statistics:
    """The statistics of some items' texts."""
    codes, distinct, offsets = terms_of(pa.array([split_item(t or "")[0] for t in items], pa.large_string()))
    n, total, longest = 0, 0, 0
    holders = np.zeros(len(distinct), np.int64)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        for at in part_starts(b - a):
            part = codes[a + at : min(a + at + PART_WORDS, b)]
            n, total, longest = n + 1, total + len(part), max(longest, len(part))
            holders[np.unique(part)] += 1
    return Statistics(n, total / max(n, 1), longest, dict(zip(distinct.to_pylist(), holders.tolist())))


def build_index(items: list[tuple], whole: Statistics | None = None) -> Index | None:
    """Index (item, text) pairs; None if they have no word.

    ``whole`` has the statistics of a benchmark of which these are a share.
    """
    whole = whole or count_parts([t for _, t in items])
    asked = [split_item(t or "") for _, t in items]
    codes, distinct, offsets = terms_of(pa.array([q for q, _ in asked], pa.large_string()))
    names = distinct.to_pylist()
    terms = {t: i for i, t in enumerate(names)}
    a_codes, a_distinct, a_offsets = terms_of(pa.array([a for _, a in asked], pa.large_string()))
    known = [terms.setdefault(t, len(terms)) for t in a_distinct.to_pylist()]
    parts, owner, answers, reach = [], [], [], []
    for i, (item, _) in enumerate(items):
        words = codes[offsets[i] : offsets[i + 1]].tolist()
        answer = frozenset(known[c] for c in a_codes[a_offsets[i] : a_offsets[i + 1]].tolist())
        for at in part_starts(len(words)):
            last = at + PART_WORDS >= len(words)
            parts.append(words[at : at + PART_WORDS])
            owner.append(item)
            answers.append(answer if last else frozenset())
            reach.append(int(a_offsets[i + 1] - a_offsets[i]) if last else 0)
    if not parts:
        return None
    n, mean = whole.parts, whole.mean
    holders = np.array([whole.holders.get(t, 0) for t in terms], float)
    idf = np.log(1 + (n - holders + 0.5) / (holders + 0.5))
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, p in enumerate(parts):
        uses: dict[int, int] = {}
        for t in p:
            uses[t] = uses.get(t, 0) + 1
        weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(p) / mean)) for t, f in sorted(uses.items())}
        against_itself = sum(weight.values())
        for t, w in weight.items():
            postings[t].append((i, float(w / against_itself)))
    starts, blocks, most, maxima = [0], [], [], []
    for posting in postings:
        tops: dict[int, float] = {}
        for i, w in posting:
            tops[i // BLOCK] = max(tops.get(i // BLOCK, 0.0), w)
        blocks += tops.keys()
        most += tops.values()
        starts.append(len(blocks))
        maxima.append(tops)
    grams = [frozenset(tuple(p[i : i + GRAM]) for i in range(max(1, len(p) - GRAM + 1))) for p in parts]
    window = 2 * max(64, whole.longest)
    return Index(owner, parts, answers, grams, terms, postings, maxima, [max(m.values(), default=0.0) for m in maxima], np.array(starts), np.array(blocks, np.int64), np.array(most), (len(parts) - 1) // BLOCK + 1, window, reach)


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """Every (part, score) with a score of ``threshold`` or more for a passage with these terms."""
    lists = [index.postings[t] for t in terms if index.postings[t]]
    blocks = [index.blocks[t] for t in terms if index.postings[t]]
    tops = [index.tops[t] for t in terms if index.postings[t]]
    at = [0] * len(lists)
    low = threshold - 1e-9  # sums in another order may differ in their last bits
    out = []
    live = list(range(len(lists)))
    while live:
        live.sort(key=lambda i: lists[i][at[i]][0])
        bound, pivot = 0.0, -1
        for place, i in enumerate(live):
            bound += tops[i]
            if bound >= low:
                pivot = place
                break
        if pivot < 0:
            break
        part = lists[live[pivot]][at[live[pivot]]][0]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == part:
            pivot += 1
        block = part // BLOCK
        if sum(blocks[i].get(block, 0.0) for i in live[: pivot + 1]) < low:
            # no part of this block before the next list's cursor can reach the threshold
            goal = (block + 1) * BLOCK
            if pivot + 1 < len(live):
                goal = min(goal, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
            moved = live[: pivot + 1]
        elif lists[live[0]][at[live[0]]][0] == part:
            here = [i for i in live if lists[i][at[i]][0] == part]
            score = sum(lists[i][at[i]][1] for i in here)
            if score >= low:
                out.append((part, score))
            goal, moved = part + 1, here
        else:
            goal, moved = part, live[:pivot]
        for i in moved:
            posting, k = lists[i], at[i]
            while k < len(posting) and posting[k][0] < goal:
                k += 1
            at[i] = k
        live = [i for i in live if at[i] < len(lists[i])]
    return out


def leaks_of(text: pa.Array, index: Index, threshold: float = THRESHOLD) -> list[tuple]:
    """(row, item, score, question share, answer share): the best verified hit of each row and item."""
    codes, distinct, offsets = terms_of(text)
    term = np.array([index.terms.get(t, -1) for t in distinct.to_pylist()], np.int64)
    terms = term[codes] if len(codes) else codes
    size = np.diff(offsets)
    half = index.window // 2
    n_windows = np.maximum((size + half - 1) // half - 1, (size > 0).astype(np.int64))
    first_window = np.cumsum(n_windows) - n_windows
    row = W.rows_of(offsets)
    in_row = np.arange(len(codes)) - offsets[:-1][row]
    hit = np.flatnonzero(terms >= 0)
    row, in_row, hit_terms = row[hit], in_row[hit], terms[hit]
    # a word lies in window k = place // half and in the one before
    late = np.minimum(in_row // half, n_windows[row] - 1)
    early = np.maximum(in_row // half - 1, 0)
    both = early < late
    window = np.concatenate([first_window[row] + late, first_window[row[both]] + early[both]])
    n_terms = len(index.postings)
    pairs = np.unique(window * n_terms + np.concatenate([hit_terms, hit_terms[both]]))
    window, used = pairs // n_terms, pairs % n_terms
    count = index.block_start[used + 1] - index.block_start[used]
    may: list[np.ndarray] = []
    total = np.concatenate([[0], np.cumsum(count)])
    cut = 0
    while cut < len(used):  # about four million entries at a time, at window borders
        end = int(np.searchsorted(total, total[cut] + 4_000_000, side="left"))
        end = len(used) if end >= len(used) else max(int(np.searchsorted(window, window[end], side="left")), 0)
        if end <= cut:
            end = int(np.searchsorted(window, window[cut], side="right"))
        c = count[cut:end]
        ends = np.cumsum(c)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.block_start[used[cut:end]] - ends + c, c)
        from_window = window[cut]
        place = np.repeat(window[cut:end] - from_window, c) * index.n_blocks + index.block_of[entry]
        bound = np.bincount(place, index.block_max[entry])
        may.append(np.unique(np.flatnonzero(bound >= threshold - 1e-9) // index.n_blocks) + from_window)
        cut = end
    wanted = np.concatenate(may) if may else np.zeros(0, np.int64)
    best: dict[tuple, tuple[float, float, float]] = {}
    window_row = np.repeat(np.arange(len(size)), n_windows)
    for w in wanted.tolist():
        a, b = np.searchsorted(window, [w, w + 1])
        found = wand(index, used[a:b].tolist(), threshold)
        if not found:
            continue
        r = int(window_row[w])
        begin = int(offsets[r]) + (w - int(first_window[r])) * half
        stop = int(offsets[r + 1]) if w - first_window[r] == n_windows[r] - 1 else min(begin + index.window, int(offsets[r + 1]))
        words = terms[begin:stop].tolist()
        for part, score in found:
            long = min(GRAM, len(index.parts[part]))
            grams = {tuple(words[i : i + long]) for i in range(len(words) - long + 1)}
            question = len(grams & index.grams[part]) / len(index.grams[part])
            answer = 1.0
            if index.answers[part]:  # it may go on behind the window
                own = set(terms[begin : min(stop + index.reach[part], int(offsets[r + 1]))].tolist())
                answer = len(own & index.answers[part]) / len(index.answers[part])
            if question >= QUESTION_SHARE and answer >= ANSWER_SHARE:
                at = (r, index.items[part])
                best[at] = max(best.get(at, (0.0, 0.0, 0.0)), (score, question, answer))
    return [(*at, *b) for at, b in sorted(best.items())]


def _count_terms(batches):
    for batch in batches:
        found = count_parts(batch.column(0).to_pylist())
        terms = pa.array([None, *found.holders], pa.string())
        rest = [0] * len(found.holders)
        counts = [[found.parts, *found.holders.values()], [round(found.parts * found.mean), *rest], [found.longest, *rest]]
        yield pa.RecordBatch.from_arrays([terms, *(pa.array(c, pa.int64()) for c in counts)], ["term", "n", "words", "longest"])


def _indexes(benchmark: DataFrame, item: str, text: str):
    """The indexes of the benchmark's items, a bounded number of items each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    rounds = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE))
    counts = None
    if rounds > 1:
        counts = items.select("item_text").mapInArrow(_count_terms, "term string, n long, words long, longest long")
        counts = stored(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "item-terms")
        n, words, longest = counts.where("term IS NULL").select("n", "words", "longest").first()
    for k in range(rounds):
        some = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(rounds)) == k)
        rows = sorted((r["item"], r["item_text"]) for r in some.collect())
        whole = None
        if counts is not None:  # the holders of this round's terms
            own = spark.createDataFrame(pa.table({"term": pa.array(list(count_parts([t for _, t in rows]).holders), pa.string())}))
            holders = counts.join(own, "term").select("term", "n").collect()
            whole = Statistics(n, words / max(n, 1), longest, {r["term"]: r["n"] for r in holders})
        index = build_index(rows, whole)
        if index is not None:
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame, key="doc_id", text="text", item="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """(key, item, score, question_share, answer_share) for each document and item it holds."""
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    kinds = (to_arrow_type(benchmark.schema[item].dataType), pa.float64(), pa.float64(), pa.float64())
    schema = f"key {kind}, item_id {item_kind}, score double, question_share double, answer_share double"
    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("searched_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(_indexes(benchmark, item, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            for batch in W.slices(batches, "searched_text"):
                found = leaks_of(W.text_of(batch, "searched_text"), shared.value, threshold)
                row, *rest = zip(*found) if found else ([],) * 5
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(rest, kinds)]]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", "score", "question_share", "answer_share"])

        found = pair.mapInArrow(search, schema)
        out = found if k == 0 else out.union(found)
    return out.withColumnRenamed("key", key)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text="text", item="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for index in _indexes(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for batch in W.slices(batches, text):
                bad = {f[0] for f in leaks_of(W.text_of(batch, text), shared.value, threshold)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_share", 6).alias("question_share"), F.round("answer_share", 6).alias("answer_share"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL: dict[str, str] = {}
