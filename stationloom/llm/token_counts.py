"""Token counts without tokens: Viterbi over a unigram vocabulary.

For each distinct unit of a batch, an Aho-Corasick automaton enumerates the
vocabulary's matches and dynamic programming carries the best score and its
piece count (``_unigram.best``, with the tokenizers' tie rule).  A text's
figures are the sums over its units.

Defined results: a null or empty text has no token and score 0; repeated rows
are counted each; an empty table gives an empty result; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _unigram as U
from . import _words as W

MODEL = "piece_bpe_32k.model"
_caches: dict[str, U.UnitCache] = {}
W.FORGET["counts"] = _caches.clear


def count_pieces(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece count and best score of each text."""
    vocab = U.vocabulary(path)
    cache = _caches.setdefault(path, U.UnitCache(lambda unit: U.best(vocab, unit)))
    codes, distinct, offsets = U.units_of(text, vocab)
    found = np.array(cache(distinct.to_pylist()), dtype=float).reshape(-1, 2)
    return W.sums(found[:, 1].astype(np.int64)[codes], offsets), W.sums(found[:, 0][codes], offsets)


def count_tokens(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """(key, n_tokens, best_score) for each row of ``docs``."""
    kind = dict(docs.dtypes)[key]

    def count(batches):
        for batch in W.slices(batches, "counted_text", owner="counts"):
            n, score = count_pieces(W.text_of(batch, "counted_text"), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(score)], ["key", "n_tokens", "best_score"])

    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("counted_text"))
    return pair.mapInArrow(count, f"key {kind}, n_tokens long, best_score double").withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(MODEL))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
