"""Secret scans: three base patterns, and novelty under a primed compressor.

Base spans are the leftmost non-overlapping matches of each kind that are long
enough.  The method adds spans of kind ``novel``: a run of 16 or more key
characters with letters and digits, close behind a sensitive word and apart
from the base spans, is compressed with a zstandard dictionary of common
identifiers and the text around it.  A run that costs nearly as many more bytes
as it has characters cannot be told from its surroundings: it is reported.

Defined results: a null or empty text has no span; base spans always stay, and
a candidate that touches one is not judged; spans are in code points, by start
and then in the order assign, access, hex, novel; repeated rows are scanned
each; an empty table gives an empty result; ``redact_secrets`` keeps all other
columns whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = "key|secret|token|password|passwd|pwd|credential|auth|bearer|private|access|signature"
WORDS = re.compile(rf"(?a)(?=((?i:{SENSITIVE})))")
#: A run of key characters starts at most so far behind a sensitive word, on its line.
REACH = 40
HEAD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}")
#: ``=`` parts a name from its value, and belongs to a run only as padding.
RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Texts that none of these finds have no span.
MAY = [r"(?i)(password|passwd|secret|token|api_?key)", "AKIA", "[0-9a-f]{16}", rf"(?i)({SENSITIVE})"]
AROUND = 1000  # characters on each side that prime the compressor
NOVEL_SHARE = 0.8  # marginal bytes a character from which a run is reported
IDENTIFIERS = " ".join(
    "access_key accessToken account admin api_key apikey application auth authorization bearer client_id client_secret config "
    "configuration connection credentials database default development environment example hostname identifier import localhost "
    "parameter password placeholder private_key production public_key refresh_token request response secret_key session signature "
    "test token undefined username value variable version your-api-key-here changeme 0123456789 abcdefghijklmnopqrstuvwxyz".split()
)


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)
    return len(pack.compress(candidate.encode())) - len(pack.compress(b""))


def _runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of every run of key characters within reach of a sensitive word, sorted."""
    out: dict[int, int] = {}
    for m in WORDS.finditer(text):
        at = m.end(1)
        line = text.find("\n", at, at + REACH)
        last = at + REACH if line < 0 else line
        for head in HEAD.finditer(text, at, last + 16):
            if head.start() not in out:
                out[head.start()] = RUN.match(text, head.start()).end()
    return sorted(out.items())


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted; kind is the place in ``KINDS``."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    base, taken = list(spans), 0
    for start, end in _runs(text):
        run = text[start:end]
        while taken < len(base) and base[taken][2] <= start:
            taken += 1
        touched = any(a < end and start < b for a, _, b in base[taken : taken + 8])
        if touched or run.isalpha() or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
            continue
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        if marginal_bytes(run, around) >= NOVEL_SHARE * len(run):
            spans.append((start, 3, end))
    return sorted(spans)


def _scan(text: pa.Array) -> list[list[tuple[int, int, int]]]:
    """The spans of each text; texts that no prefilter finds are not searched."""
    may = [pc.match_substring_regex(text, r"[A-Za-z0-9+/_.=-]{12}")]
    some = pc.or_kleene(pc.or_kleene(*[pc.match_substring_regex(text, m) for m in MAY[:2]]), pc.or_kleene(*[pc.match_substring_regex(text, m) for m in MAY[2:]]))
    wanted = pc.and_(may[0], some).to_pylist()
    return [find_secrets(t.as_py()) if w else [] for t, w in zip(text, wanted)]


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for each row."""
    kind = dict(docs.dtypes)[key]
    names = ["key", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def scan(batches):
        for batch in W.slices(batches, "scanned_text"):
            found = _scan(W.text_of(batch, "scanned_text"))
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(_spelled(s for s in spans if s[1] < 3).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array(map(_spelled, found))], names)

    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("scanned_text"))
    schema = f"key {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return pair.mapInArrow(scan, schema).withColumnRenamed("key", key)


def redacted(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, last = [], 0
    for start, _, end in spans:
        if start >= last:
            out += [text[last:start], "[REDACTED]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, text="text", size: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; ``size`` names a column that holds its length."""

    def redact(batches):
        for batch in W.slices(batches, text):
            place = batch.schema.get_field_index(text)
            source = W.text_of(batch, text)
            found = _scan(source)
            if any(found):
                new = [redacted(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), found)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
                if size is not None:
                    at = batch.schema.get_field_index(size)
                    length = [len(t) if s else n for t, s, n in zip(new, found, batch.column(at).to_pylist())]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(length, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(redact, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE_SQL: dict[str, str] = {}
