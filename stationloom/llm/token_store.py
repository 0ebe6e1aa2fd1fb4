"""Token ids in a content-addressed store.

``write_store`` encodes documents, ends each with an end id, and cuts its ids
where a rolling hash of the last ``WINDOW`` ids asks for it.  Layout under the
store's path:

* ``segments/``: one row for each chunk of each document (digest, n, ids,
  doc_row, key, seq); ``digest`` is the SHA-256 of the ids' little-endian bytes,
  and ``ids`` holds those bytes in exactly one row of each digest;
* ``recipes/part=N/``: one row for each document in ascending order of its key
  (part N before part N+1): start, n_tokens, the digests in order, and the
  document's root, the hash of its digests;
* ``manifest/``: the hashes of blocks of document roots, of each part's blocks,
  and of all parts.

``read_digests`` and ``read_documents`` read a store back and verify it: every
chunk against its digest, every recipe against its root and its token count,
the manifest against the roots.  The CRC of a document is the XOR of its
chunks' CRCs, each shifted by the bytes behind it, so that verification moves
no ids between tasks.

Defined results: a null text counts as empty and has the end id alone;
documents with equal keys follow each other in input order; null keys come
first; an empty table gives an empty store; other columns are not read.  A
digest that very many documents refer to (empty and repeated texts) is one row
on the side of the chunks; adaptive execution splits the other side.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import new_path, remove, stored

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WINDOW = 16
#: Chunk sizes in ids: least, average (a power of two), most.
LEAST, AVERAGE, MOST = 128, 512, 2048
BLOCK = 4096
#: Units, and ids of them, that a process keeps.
KNOWN_UNITS, KNOWN_IDS = 600_000, 3_000_000
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Deletes the letters of ASCII and Latin-1, and the space.
_LATIN = dict.fromkeys([0x20, *range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])
_SPACES = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
_POWERS = tuple(np.uint32(pow(0x01000193, WINDOW - 1 - k, 1 << 32)) for k in range(WINDOW))
_seen: dict[str, _Known] = {}
W.FORGET["token store"] = _seen.clear


# --- encoding -------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Known:
    """The ids of the units that a process met first, one after another."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ends = np.zeros(KNOWN_UNITS + 1, np.int64)
        self.ids = np.empty(KNOWN_IDS, np.uint32)

    def keep(self, units: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.place)
        ends = self.ends[n] + np.cumsum(sizes)
        fit = min(KNOWN_UNITS - n, int(np.searchsorted(ends, KNOWN_IDS, side="right")))
        if fit > 0:
            self.ids[self.ends[n] : ends[fit - 1]] = ids[: ends[fit - 1] - self.ends[n]]
            self.ends[n + 1 : n + 1 + fit] = ends[:fit]
            self.place.update(zip(units[:fit], range(n, n + fit)))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _encoded(units: list[str], path: str) -> list[list[int]]:
    """Each unit's ids.

    A unit of letters, with or without a space before it, is one pre-token, so
    the tokenizer's model takes it as it is; others go through the tokenizer.
    """
    tokenizer, letters = _tokenizer(path), _byte_letters()
    model, out, mixed = tokenizer.model, [], []
    for i, unit in enumerate(units):
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()) and unit.lower().translate(_LATIN) == "":
            out.append([t.id for t in model.tokenize(unit.encode().decode("latin-1").translate(letters))])
        else:
            out.append([])
            mixed.append(i)
    for k in range(0, len(mixed), 4096):
        part = mixed[k : k + 4096]
        for i, got in zip(part, tokenizer.encode_batch([units[i] for i in part], add_special_tokens=False)):
            out[i] = got.ids
    return out


def _unit_ids(units: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units, and each unit's count; the first units that a process meets stay known."""
    known = _seen.setdefault(path, _Known())
    place = np.fromiter(map(known.place.get, units, repeat(-1)), np.int64, len(units))
    old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    sizes = np.empty(len(units), np.int64)
    at = place[old]
    sizes[old] = known.ends[at + 1] - known.ends[at]
    made = _encoded([units[i] for i in new.tolist()], path)
    sizes[new] = [len(m) for m in made]
    fresh = np.fromiter(chain.from_iterable(made), np.uint32)
    begin = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.uint32)
    ids[_ragged(begin[old], sizes[old])] = known.ids[_ragged(known.ends[at], sizes[old])]
    ids[_ragged(begin[new], sizes[new])] = fresh
    if len(new):
        short = [len(units[i]) < 40 for i in new.tolist()]
        named = [units[i] for i, s in zip(new.tolist(), short) if s]
        known.keep(named, sizes[new][short], fresh[np.repeat(short, sizes[new])])
    return ids, sizes


def encode_flat(text: pa.Array, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all whole texts one after another, each with ``end`` behind it if given, and their offsets.

    Byte-level pre-tokenisation always breaks before a single space between
    two other characters, between a letter and punctuation or a line's end,
    and between a letter and a line's end before it that follows no other
    white space (of a run, its last character stands apart from the others),
    so a text is cut there and equal units are encoded once.  Texts with other
    runs of white space at a space, or with a special token's string, are
    encoded as they are.
    """
    special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    odd = pc.match_substring_regex(text, f"^ | $| {_SPACES}|{_SPACES} |\\x00|^$")
    for token in special:
        odd = pc.or_(odd, pc.match_substring(text, token))
    odd = odd.to_numpy(zero_copy_only=False)
    size = np.zeros(len(text), np.int64)
    plain, by_hand = np.flatnonzero(~odd), np.flatnonzero(odd)
    whole = [_tokenizer(path).encode(text[i].as_py(), add_special_tokens=False).ids for i in by_hand.tolist()]
    size[by_hand] = [len(w) for w in whole]
    ids = np.zeros(0, np.uint32)
    if len(plain):
        cut = pc.replace_substring(text.take(pa.array(plain)), " ", "\x00 ")
        cut = pc.replace_substring_regex(cut, rf"({_LETTER})([.,;:!?|\n$%&#*()\"])", "\\1\x00\\2")
        cut = pc.replace_substring_regex(cut, rf"([^\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]\n)({_LETTER})", "\\1\x00\\2")
        flat, offsets = W.flat_parts(pc.split_pattern(cut, "\x00"), drop_empty=False)
        codes, distinct = W.coded(flat)
        table, of_unit = _unit_ids(distinct.to_pylist(), path)
        begin = (np.cumsum(of_unit) - of_unit)[codes]
        of_unit = of_unit[codes]
        ids = table[_ragged(begin, of_unit)]
        size[plain] = np.diff(np.concatenate([[0], np.cumsum(of_unit)])[offsets])
    ends = np.cumsum(size + (end is not None))
    start = ends - size - (end is not None)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    out[_ragged(start[plain], size[plain])] = ids
    for i, w in zip(by_hand.tolist(), whole):
        out[start[i] : start[i] + size[i]] = w
    if end is not None:
        out[ends - 1] = end
    return out, np.concatenate([[0], ends])


def encode_texts(text: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each whole text."""
    ids, offsets = encode_flat(text, path)
    return np.split(ids, offsets[1:-1]) if len(text) else []


# --- chunks ---------------------------------------------------------------


def _wanted(ids: np.ndarray) -> np.ndarray:
    """Places behind the windows whose hash has nine zero bits."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    mixed = (ids * np.uint32(2654435761)) ^ (ids * np.uint32(2246822519) >> np.uint32(15))
    rolled = np.zeros(len(ids) - WINDOW + 1, np.uint32)
    for k, power in enumerate(_POWERS):
        rolled += mixed[k : len(mixed) - WINDOW + 1 + k] * power
    return np.flatnonzero((rolled >> np.uint32(7)) % np.uint32(AVERAGE) == 0) + WINDOW


def _ends(wanted: list[int], n: int) -> list[int]:
    """The ends of a document's chunks: wanted places, within the size limits."""
    if n <= LEAST:
        return [n]
    ends, last = [], 0
    for at in [*wanted, n]:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST or at == n and at > last:
            ends.append(at)
            last = at
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """The ends of a document's chunks."""
    return _ends(_wanted(ids.astype(np.uint32)).tolist(), len(ids))


def _segments(batches, path: str, end_id: int):
    """Chunk rows of documents; a chunk that this task has sent lately goes without its ids."""
    sent: set[bytes] = set()
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in W.slices(batches, "stored_text", 3 << 20, "token store"):
        rows: list[tuple] = []
        ids, offsets = encode_flat(W.text_of(batch, "stored_text"), path, end_id)
        wanted = _wanted(ids)
        # a window lies within one document
        first, last = np.searchsorted(wanted, offsets[:-1] + WINDOW), np.searchsorted(wanted, offsets[1:], side="right")
        data = ids.astype("<u4").tobytes()
        small = ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else None
        for at_row, (a, b, i, j) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), first.tolist(), last.tolist())):
            at = a
            for seq, end in enumerate(_ends((wanted[i:j] - a).tolist(), b - a)):
                end += a
                digest = hashlib.sha256(data[4 * at : 4 * end]).digest()
                packed = None
                if digest not in sent:
                    packed = b"\x02" + small[2 * at : 2 * end] if small is not None else _packed(data[4 * at : 4 * end])
                    sent.add(digest)
                rows.append((at_row, seq, end - at, digest, packed))
                at = end
        if len(sent) > 200_000:
            sent.clear()
        at_row, *rest = (pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(1).take(at_row), *rest], ["doc_row", "key", "seq", "n", "digest", "ids"])


def _packed(data: bytes) -> bytes:
    """Ids below 65,536 take two bytes each; the first byte tells the width."""
    ids = np.frombuffer(data, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + data


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


# --- writing --------------------------------------------------------------


def _hash_of(hashes) -> F.Column:
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def write_store(docs: DataFrame, path: str, tokenizer: str, key="doc_id", text="text", end_id=END_ID) -> None:
    """Encode ``docs`` into a new store at ``path``."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(key).alias("key"), F.col(text).alias("stored_text"))
    kind = dict(docs.dtypes)[key]
    rows = numbered.mapInArrow(
        lambda batches: _segments(batches, tokenizer, end_id), f"doc_row long, key {kind}, seq int, n int, digest binary, ids binary"
    )
    # rows with ids meet by digest; the others, however often their digest occurs, are dealt evenly
    meet = F.when(F.col("ids").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_row", "seq"))
    first = F.row_number().over(Window.partitionBy("meet", "digest").orderBy("doc_row", "seq")) == 1
    # hash partitions of "meet" serve the window too
    once = rows.withColumn("meet", meet).repartition("meet").withColumn("ids", F.when(first, F.col("ids"))).drop("meet")
    once.write.option("compression", "zstd").parquet(f"{path}/segments")

    refs = spark.read.parquet(f"{path}/segments").select("doc_row", "key", "seq", "n", "digest")
    listed = refs.groupBy("doc_row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("seq", F.lower(F.hex("digest")).alias("digest"))))["digest"].alias("digests"), F.sum("n").alias("n_tokens"))
    ranged = listed.repartitionByRange("key", "doc_row").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part
    before, run = [], 0
    for r in totals:
        before.append((r["part"], run))
        run += r["n"]
    order = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "doc_row")
    recipes = (
        ranged.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("root", _hash_of("digests"))
    )
    recipes.select("part", "key", "place", "start", "n_tokens", "root", "digests").sortWithinPartitions("part", "place").write.partitionBy("part").parquet(f"{path}/recipes")
    remove(spark, ranged)
    _manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    # a partitioned table without rows has no file to tell its schema
    kind = dict(spark.read.parquet(f"{path}/segments").dtypes)["key"]
    return spark.read.schema(f"key {kind}, place int, start long, n_tokens long, root string, digests array<string>, part int").parquet(f"{path}/recipes")


def _manifest(recipes: DataFrame) -> DataFrame:
    """The Merkle levels above the documents: blocks, parts, all."""
    block = F.floor((F.col("place") - 1) / BLOCK).cast("int")
    roots = lambda order, of: _hash_of(F.sort_array(F.collect_list(F.struct(order, of)))[of])
    blocks = recipes.groupBy("part", block.alias("block")).agg(roots("place", "root").alias("root"))
    parts = blocks.groupBy("part").agg(roots("block", "root").alias("root")).withColumn("block", F.lit(None).cast("int"))
    whole = parts.agg(roots("part", "root").alias("root")).select(F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("block"), "root")
    return blocks.unionByName(parts).unionByName(whole)


# --- reading --------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reflected."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(a)
    for k in range(32):
        out ^= np.where(a >> np.uint64(31 - k) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(_POLY), np.uint64(0))
    return out


@lru_cache(maxsize=1)
def _powers() -> list[int]:
    """x to the power 2**k, for k below 64."""
    power = np.array([1 << 30], np.uint64)
    out = []
    for _ in range(64):
        out.append(int(power[0]))
        power = _times(power, power)
    return out


def shifted_crc(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What a part with this CRC adds to the CRC of the whole, ``behind`` bytes before its end."""
    out, bits = crc.astype(np.uint64), behind.astype(np.int64) * 8
    for k in range(int(bits.max(initial=0)).bit_length()):
        has = (bits >> k) & 1 == 1
        if has.any():
            out[has] = _times(out[has], np.full(int(has.sum()), _powers()[k], np.uint64))
    return out


def _chunk_facts(batches):
    for batch in batches:
        n, crc, right = [], [], []
        for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = _unpacked(packed).tobytes()
            n.append(len(data) // 4)
            crc.append(zlib.crc32(data))
            right.append(hashlib.sha256(data).digest() == digest)
        hexed = pa.array([d.hex() for d in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([hexed, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(right, pa.bool_())], ["digest", "n", "crc", "right"])


def _shift(batches):
    for batch in batches:
        crc = shifted_crc(batch.column(2).to_numpy(), batch.column(3).to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(crc.astype(np.int64)), *batch.columns[4:]], ["part", "place", "crc", "n", "right"])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise if the manifest differs from what the recipes' roots give."""
    made, kept = _manifest(_recipes(spark, path)), spark.read.parquet(f"{path}/manifest")
    if made.exceptAll(kept).unionAll(kept.exceptAll(made)).limit(1).count():
        raise ValueError("the manifest does not fit the recipes")


def read_digests(spark: SparkSession, path: str, key="doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document; fails on any damage to the store."""
    verify_manifest(spark, path)
    packed = spark.read.parquet(f"{path}/segments").where("ids IS NOT NULL").select("digest", "ids")
    facts = packed.mapInArrow(_chunk_facts, "digest string, n long, crc long, right boolean")
    facts = stored(facts, "chunk-facts")
    refs = _recipes(spark, path).select("part", "place", F.posexplode("digests").alias("seq", "digest"))
    found = refs.join(facts, "digest", "left")
    tail = Window.partitionBy("part", "place").orderBy(F.col("seq").desc())
    behind = F.sum("n").over(tail.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    moved = found.select("part", "place", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce(behind, F.lit(0)).alias("behind"), "n", F.coalesce("right", F.lit(False)).alias("right"))
    moved = moved.mapInArrow(_shift, "part int, place int, crc long, n long, right boolean")
    total = moved.groupBy("part", "place").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("found_tokens"), F.every("right").alias("right"))
    recipes = _recipes(spark, path)
    sound = (F.col("found_tokens") == F.col("n_tokens")) & F.col("right") & (_hash_of("digests") == F.col("root"))
    start = F.when(F.coalesce(sound, F.lit(False)), F.col("start")).otherwise(F.raise_error(F.lit("a document of the store is damaged")).cast("long"))
    return recipes.join(total, ["part", "place"], "left").select(F.col("key").alias(key), start.alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, key="doc_id") -> DataFrame:
    """(key, start, ids) of each document, its chunks put together again."""
    packed = spark.read.parquet(f"{path}/segments").where("ids IS NOT NULL").select(F.lower(F.hex("digest")).alias("digest"), "ids")
    recipes = _recipes(spark, path)
    refs = recipes.select("part", "place", F.posexplode("digests").alias("seq", "digest")).join(packed, "digest", "left")
    parts = refs.groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "ids"))).alias("chunks"))

    def join(batches):
        for batch in batches:
            out = []
            for chunks in batch.column(2).to_pylist():
                ids = [_unpacked(c["ids"]) for c in chunks]
                if any(hashlib.sha256(i.tobytes()).hexdigest() != c["digest"] for i, c in zip(ids, chunks)):
                    raise ValueError("a chunk of the store is damaged")
                out.append(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], ["part", "place", "ids"])

    whole = parts.mapInArrow(join, "part int, place int, ids array<int>")
    return recipes.join(whole, ["part", "place"]).select(F.col("key").alias(key), "start", "ids")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path(TOKENIZER))
    return read_digests(spark, path)


QUERIES = {"op2_token_store": op2_token_store}
ORACLE_SQL: dict[str, str] = {}
