"""SimHash, token store, counts, sampled pieces, language model, pipeline."""

import ctypes
import math
import random
import re
import threading
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from test_text_operators import EDGES, WORD, edge_docs

from stationloom.llm import _unigram, lm_scoring, piece_sampling, simhash, token_counts, token_store
from stationloom.llm._shared import components, new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def ascii_lower(text):
    return text.encode().lower().decode()


def plain_fingerprint(text, width=3):
    words = WORD.findall(ascii_lower(text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, links):
    at = {v: v for v in values}

    def root(v):
        while at[v] != v:
            v = at[v]
        return v

    for u, v in links:
        a, b = root(u), root(v)
        at[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def test_fingerprints():
    rng = random.Random(1)
    texts = [t or "" for t in EDGES] + ["".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = simhash.fingerprints_of(pa.array(texts, pa.large_string()))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("leaf_rows", [8, 64, 16_384])
def test_trie_join(spark, leaf_rows):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for _ in range(6):
            b ^= 1 << rng.randrange(64)  # chains of one and two bits
            values.add(b)
            b ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(b)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    near = [(u, v) for i, u in enumerate(values) for v in values[:i] if ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2]
    frame = spark.createDataFrame([(v, v) for v in values], "fp long, item long")
    links = simhash.trie_join(frame, len(values) // 8, 2, leaf_rows)  # so few rows expected: small leaves are cut into parts
    want = {u: r for u, r in plain_groups(values, near).items() if any(u in p for p in near)}
    assert {r["node"]: r["label"] for r in components(links).collect()} == want
    assert set(map(tuple, links.collect())) <= {(u, v) for u in want for v in want if want[u] == want[v]}


def test_trie_links_within_and_across():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64) | (rng.integers(0, 4, 400).astype(np.uint64) << np.uint64(60)))
    u, v = simhash.trie_links(values, None, 0, 0, 2)
    near = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]
    want = plain_groups(range(len(values)), near)
    assert plain_groups(range(len(values)), zip(u.tolist(), v.tolist())) == want


def test_repeated_values_and_sketches():
    values = np.array([5, 5, 5, 7, 1 << 50], np.uint64)
    u, v = simhash.trie_links(values, None, 0, 0, 1)
    assert plain_groups(range(5), zip(u.tolist(), v.tolist())) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    u, v = simhash.trie_links(values, None, 0, 0, 1, lambda x, y: (x == 0) & (y == 2) | (x == 2) & (y == 0))
    assert plain_groups(range(5), zip(u.tolist(), v.tolist())) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    rng = random.Random(4)
    edges = [(u, v) if rng.random() < 0.5 else (v, u) for u, v in chain + star] + [(7, 7)]
    rng.shuffle(edges)
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("the of and to in it is".split()) + str(rng.randrange(50)) for _ in range(n))
    long = say(900)
    texts = [long, long + " end", long.upper(), say(30), say(30)]
    docs = edge_docs(spark, texts)
    all_texts = [t or "" for t in [*EDGES, *texts]]
    fps = [plain_fingerprint(t) for t in all_texts]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = plain_groups(range(len(fps)), near)
    found = simhash.near_duplicates(docs, leaf_rows=4).collect()
    assert len(found) == docs.count() and all(want[r["key"]] == r["component"] for r in found)
    assert want[len(EDGES) + 2] == len(EDGES)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_short_fingerprints_of_several_tries(spark):
    rng = random.Random(16)
    rows = [(i, t, rng.getrandbits(12) << 52) for i in range(150) for t in range(2)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(i, t, signed(v)) for i, t, v in rows], "item long, trie int, fp long")
    near = [(i, j) for i, t, v in rows for j, t2, v2 in rows if j < i and t == t2 and (v ^ v2).bit_count() <= 1]
    want = {u: r for u, r in plain_groups(range(150), near).items() if any(u in p for p in near)}
    links = simhash.trie_join(frame, 150, 1, 16, 12)
    assert {r["node"]: r["label"] for r in components(links).collect()} == want


def five_words(text):
    words = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def with_copies(rng, n, changes):
    """Texts, and copies of them: (text, place of the source or None)."""
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)]
    say = lambda k: rng.choices(vocab, weights=[1 / (i + 1) for i in range(2000)], k=k)
    out = []
    for i in range(n):
        words = say(rng.randint(80, 400))
        out.append((" ".join(words), None))
        source, size = len(out) - 1, len(words)
        for change in changes:
            copy = list(words)
            if change == "appended":
                copy += say(int(rng.uniform(0.05, 0.24) * size))
            elif change == "headed":
                copy = say(int(rng.uniform(0.05, 0.24) * size)) + copy
            elif change == "cut":
                copy = copy[: int(rng.uniform(0.81, 0.95) * size)]
            elif change == "block":
                k = int(rng.uniform(0.02, 0.10) * size)
                at = rng.randrange(size - k)
                copy[at : at + k] = say(k)
            else:
                for k in rng.sample(range(size), max(1, size // 60)):
                    copy[k] = rng.choice(vocab)
            out.append((" ".join(copy), source))
    return out


def test_copies_of_all_kinds_are_found(spark):
    kinds = ["appended", "headed", "cut", "block", "scattered"]
    texts = with_copies(random.Random(6), 60, kinds)
    sets = [five_words(t) for t, _ in texts]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    label = {r["key"]: r["label"] for r in simhash.copy_groups(table).collect()}
    for kind in range(len(kinds)):  # each kind on its own, against the exact similarity
        near = [i for i, (_, source) in enumerate(texts) if source is not None and (i - source - 1) == kind and alike(sets[i], sets[source])]
        assert len(near) > 30 and sum(label[i] == label[texts[i][1]] for i in near) >= 0.95 * len(near)
    exact = plain_groups(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    for i in range(len(texts)):  # nothing else is linked
        assert all(exact[i] == exact[j] for j in range(i) if label[i] == label[j])


@pytest.mark.parametrize("leaf_rows, group_sets", [(16_384, 2048), (16, 8)])
def test_near_copies_go(spark, leaf_rows, group_sets):
    rng = random.Random(18)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    hot = []
    for k in range(60):  # one large group: each differs from the first in a word or two
        copy = list(words)
        for _ in range(k % 3):
            copy[rng.randrange(120)] = f"x{k}"
        hot.append(" ".join(copy))
    texts = [*hot, *(t for t, _ in with_copies(rng, 15, ["appended", "scattered"]))]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    rows += [(0, texts[0], 2), (0, texts[0].upper(), 2), (None, texts[0], 3), (None, "alone", 3), (None, None, 4), (7000, "", 4), (7000, " ", 4)]
    rows += [(8000, "one text here", 5), (8000, "quite another text", 5), (8000, "quite another text", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    kept = simhash.drop_near_copies(table, leaf_rows=leaf_rows, group_sets=group_sets)
    assert kept.columns == table.columns
    found = Counter(map(tuple, kept.collect()))
    sets = [five_words(t) for _, t, _ in rows]
    exact = plain_groups(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    groups = {}
    for i, root in exact.items():
        groups.setdefault(root, []).append(i)
    assert sum(found.values()) == len(groups) and max(found.values()) == 1
    ids = sorted(r[0] for r in found if r[0] is not None)
    want = [min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in groups.values()]
    assert ids == sorted(k for k in want if k is not None) and ids.count(8000) == 2
    assert simhash.drop_near_copies(table.limit(0)).count() == 0


def test_exact_links_in_parts(spark):
    rng = random.Random(19)
    sets = []
    for i in range(120):
        base = range(1000 * (i % 4), 1000 * (i % 4) + 40)
        gone = rng.sample(list(base), rng.randint(0, 6))
        sets.append((i % 4 // 2, i, sorted((set(base) - set(gone)) | {10_000 + 50 * i + k for k in range(rng.randint(0, 5))})))
    near = [(i, j) for _, i, a in sets for _, j, b in sets if j < i and alike(set(a), set(b))]
    want = plain_groups(range(120), near)
    frame = spark.createDataFrame(sets, "cluster long, item long, shingles array<long>")
    for group_sets in (2048, 7):
        found = {r["node"]: r["label"] for r in components(simhash.copy_links(frame, group_sets)).collect()}
        assert {i: found.get(i, i) for i in range(120)} == want


def test_the_chance_to_miss_stays():
    for rows in (1, 1000, 10**6, 10**9, 10**11):
        bits, tries = simhash.copy_tries(rows)
        assert bits <= 60 and tries <= 250
        p = simhash.BIT_CHANCE
        one = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
        assert (1 - one) ** tries <= simhash.MISS


def test_token_store(spark):
    rng = random.Random(7)
    passage = " ".join(rng.choice(["alpha", "Beta,", "γάμμα.", "1234", "it's"]) for _ in range(3000))
    texts = [*[t or "" for t in EDGES], passage, "x " + passage, "a  b\n\n c", "end<|endoftext|> of", "é.\nNext, (one) \"two\"!"]
    docs = edge_docs(spark, texts[len(EDGES) :])
    path = new_path(spark, "test-store")
    token_store.write_store(docs, path, BYTES)
    tokenizer = token_store._tokenizer(BYTES)
    want, start = [], 0
    for i, t in enumerate(texts):
        for _ in range(2):
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
            want.append((i, start, ids))
            start += len(ids)
    digests = sorted(map(tuple, token_store.read_digests(spark, path).collect()))
    assert digests == [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want]
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in token_store.read_documents(spark, path).collect()) == want
    segments = spark.read.parquet(f"{path}/segments")
    assert segments.where("ids IS NOT NULL").count() == segments.select("digest").distinct().count() < segments.count() / 2


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, "another")], "doc_id long, text string")
    path, bad = new_path(spark, "test-store"), new_path(spark, "test-bad")
    token_store.write_store(docs, path, BYTES)
    for part in ("recipes", "manifest"):
        frame = spark.read.parquet(f"{path}/{part}")
        (frame.write.partitionBy("part") if part == "recipes" else frame.write).parquet(f"{bad}/{part}")
    spark.read.parquet(f"{path}/segments").selectExpr("digest", "n", "CASE WHEN key = 1 THEN unhex('02FFFF') ELSE ids END AS ids", "doc_row", "key", "seq").write.parquet(f"{bad}/segments")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_digests(spark, bad).collect()
    with pytest.raises(Exception, match="damaged"):
        token_store.read_documents(spark, bad).collect()
    spark.read.parquet(f"{path}/manifest").selectExpr("part", "block", "'x' AS root").write.mode("overwrite").parquet(f"{bad}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify_manifest(spark, bad)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_empty_store(spark, kind):
    path = new_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([], f"doc_id {kind}, text string"), path, BYTES)
    digests = token_store.read_digests(spark, path)
    assert digests.count() == 0 and token_store.read_documents(spark, path).count() == 0
    assert dict(digests.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)


def test_ids_are_the_tokenizers():
    rng = random.Random(17)
    plain = ["a", "B", "é", "word", "Next", " ", "\n", "\n\n", "\r\n", ".", ","]
    odd = ["  ", "\t", "\x85", "\u2028", "\xa0", "\u200b", "'s", "'", '"', "(", "1", "23", "日", "\x0b", "\x1c", "ß", "K", "#", "$", "\ufeff", "<|endoftext|>", "\x01"]
    texts = ["".join(rng.choices(plain + odd, weights=[5] * len(plain) + [1] * len(odd), k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["a\n\nb", "foo.\n\nBar baz", "Title\n\nText here.\n\nMore", "\nb", "a\r\nb\nc\nd"]
    want = token_store._tokenizer(BYTES).encode_batch(texts, add_special_tokens=False)
    got = token_store.encode_texts(pa.array(texts, pa.large_string()), BYTES)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_crc_of_parts():
    data = random.Random(8).randbytes(5000)
    cuts = [0, 1, 700, 700, 4999, 5000]
    crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])])
    assert np.bitwise_xor.reduce(token_store.shifted_crc(crc, np.array([5000 - b for b in cuts[1:]]))) == zlib.crc32(data)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 50_000, 40_000).astype(np.uint32)
    a, b = token_store.cut_points(ids), token_store.cut_points(np.concatenate([ids[:5], ids]))
    assert len({len(ids) - x for x in a} & {len(ids) + 5 - x for x in b}) > 0.9 * len(a)
    sizes = np.diff([0, *a])
    assert sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()


def unigram_tokenizer():
    from tokenizers import Tokenizer, models

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    usable = lambda i: not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    vocab = [(model.id_to_piece(i), model.get_score(i) if usable(i) else -1e9) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_token_counts(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice(["the", "ing", " ", "é", ",", "\n", "日", "▁", "Z", "qu", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = edge_docs(spark, texts)
    tokenizer, space = unigram_tokenizer(), _unigram.SPACE
    found = token_counts.count_tokens(docs, PIECES).collect()
    assert len(found) == docs.count()
    for r in found:
        text = ([*EDGES, *texts][r["doc_id"]] or "").replace("", "").replace(space, "").replace(" ", space)
        want = len(tokenizer.encode(space + text, add_special_tokens=False).ids) if text else 0
        assert r["n_tokens"] == want, r
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_sampled_pieces_decode(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["the", "ing", " ", "é", ",", "\n", "日", "▁", "", "\x00", "  "]) for _ in range(rng.randint(0, 80))) for _ in range(100)]
    docs = edge_docs(spark, texts)
    encoded = piece_sampling.encode_sampled(docs, PIECES)
    decoded = {r["doc_id"]: r["text"] for r in piece_sampling.decode(encoded, PIECES).collect()}
    assert decoded == {i: t or "" for i, t in enumerate([*EDGES, *texts])}
    ids = lambda frame: {(r["doc_id"], tuple(r["ids"])) for r in frame.collect()}
    assert ids(encoded) == ids(piece_sampling.encode_sampled(docs.repartition(7), PIECES))
    assert len(ids(encoded)) == len(EDGES) + 100  # repeated rows get the same pieces
    assert ids(encoded) != ids(piece_sampling.encode_sampled(docs, PIECES, seed=8))
    assert piece_sampling.encode_sampled(docs.limit(0), PIECES).count() == 0
    # the same digests whether ids are handed on or decoded at once
    apart = {tuple(r) for r in encoded.select("doc_id", "n_pieces").join(piece_sampling.decode_digests(encoded, PIECES), "doc_id").collect()}
    at_once = [tuple(r) for r in piece_sampling.encode_digests(docs, PIECES).collect()]
    assert {r[:4] for r in at_once} == apart and all(r[4] for r in at_once) and len(at_once) == docs.count()
    assert {r[0]: r[2] for r in at_once} == {r["doc_id"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in encoded.collect()}
    assert piece_sampling.encode_digests(docs.limit(0), PIECES).count() == 0


def test_units_do_not_depend_on_the_texts_beside():
    vocab = _unigram.vocabulary(PIECES)

    def units(texts):
        codes, distinct, offsets = _unigram.units_of(pa.array(texts, pa.large_string()), vocab)
        flat = distinct.take(pa.array(codes)).to_pylist()
        return [flat[a:b] for a, b in zip(offsets, offsets[1:])]

    odd = ["x, y\u2581z. \x00w", "a,\x01\x00. b\x01\x03c, \u2581", "\x00"]
    clean = ["a, b.", "", "é. (f)  g!", " one; two:three ", "\x01a.\x02"]
    alone = [units([t])[0] for t in clean + odd]
    assert "." in alone[0] and units(clean) == alone[: len(clean)]
    assert units(clean + odd) == alone and units((clean + odd)[::-1]) == alone[::-1]
    assert [[u for u in us if u] for us in _unigram._units_by_hand(clean, vocab)] == alone[: len(clean)]
    assert ["".join(us).replace(_unigram.LITERAL, "\u2581") for us in alone] == [t and "\u2581" + t.replace(" ", "\u2581") for t in clean + odd]


def test_samples_do_not_depend_on_the_texts_beside(spark):
    rows = [(1, "words, more. And (so) on; words, more."), (2, "a\u2581b, c."), (3, "\x00 d, e.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    together, alone = (
        {r["doc_id"]: r for d in parts for r in piece_sampling.encode_sampled(d, PIECES).collect()} for parts in ([docs], [docs.where(f"doc_id = {i}") for i in (1, 2, 3)])
    )
    assert together == alone


def test_samples_have_their_shares():
    lattice = piece_sampling.Lattice(PIECES, piece_sampling.THETA)
    unit, n = "▁thering", 60_000

    def ways(at):
        if at == len(unit):
            yield (), 1.0
            return
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in lattice.vocab.matcher:
                i = lattice.vocab.matcher.get(unit[at:end])[0]
                yield from (((i, *rest), lattice.weight[i] * w) for rest, w in ways(end))

    share = dict(ways(0))
    ids, count = piece_sampling.sample_pieces(pa.array(["thering"] * n, pa.large_string()), list(range(n)), PIECES)
    ends = np.cumsum(count).tolist()
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip([0, *ends], ends))
    total = sum(share.values())
    common = {p: w / total * n for p, w in share.items() if w / total * n >= 10}
    assert set(seen) <= set(share)
    chi = sum((seen[p] - e) ** 2 / e for p, e in common.items())
    assert chi < len(common) + 5 * math.sqrt(2 * len(common))


@pytest.mark.parametrize("n", [1, 63, 130, 641, 4097, 5000, 16_385, 20_000, 50_001])
def test_every_token_is_learnt_from_once(monkeypatch, n):
    seen = []
    rng = random.Random(n)
    offsets = [0]
    while offsets[-1] < n:  # one document in twenty is longer than a lane
        offsets.append(min(n, offsets[-1] + (rng.randint(1, 30) if rng.random() < 0.95 else 3000)))
    starts = set(offsets[:-1])

    def spy(w, layout, before, target, fresh, h, live):
        assert h.shape[0] == target.shape[1] and (before[live] == np.where(np.isin(target[live], list(starts)), -1, target[live] - 1)).all()
        assert fresh[live & np.isin(target, list(starts))].all()
        follows = live[1:] & ~fresh[1:]
        assert (target[1:][follows] == target[:-1][follows] + 1).all()
        seen.append(target[live])
        return {}, h

    monkeypatch.setattr(lm_scoring, "_gradients", spy)
    trainer = lm_scoring.Trainer({}, None, -1)
    trainer.learn(np.arange(n), np.array(offsets))
    assert np.sort(np.concatenate(seen)).tolist() == list(range(n))
    assert trainer.tokens == n


def test_shards_are_cut_alike_whatever_the_batches():
    rng = random.Random(22)
    rows = sorted((rng.randrange(4), "x" * rng.randint(0, 40)) for _ in range(300))

    def cut(sizes):
        table, at, batches = pa.table({"shard": [r[0] for r in rows], "lm_text": [r[1] or None for r in rows]}).combine_chunks().to_batches()[0], 0, []
        for n in sizes:
            batches.append(table.slice(at, n))
            at += n
        return [(s, t.to_pylist()) for s, t in lm_scoring._shard_slices(batches, 100)]

    whole = cut([300])
    assert whole == cut([7] * 43) == cut([0, 150, 0, 1, 149])
    assert [(s, t or "") for s, ts in whole for t in ts] == rows
    assert all(sum(len(t or "") for t in ts) <= 100 for _, ts in whole)


@pytest.mark.parametrize("head", [1, 5, 40, 1000])
def test_head_of_the_vocabulary(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    counts = {f"w{i}": 1 + (i < 100) * 7 + (i < 3) * (100 - i) for i in range(400)}
    words, n = lm_scoring._head(spark.createDataFrame(list(counts.items()), "word string, c long"))
    got = dict(zip(words.to_pylist(), n.tolist()))
    assert all(counts[w] == c for w, c in got.items()) and len(got) <= head
    least = min(got.values(), default=10**9)
    assert all(w in got for w, c in counts.items() if c > least)
    assert head < 1000 or len(got) == 400
    assert list(got.items()) == sorted(got.items(), key=lambda x: (-x[1], x[0]))


def test_gradients_of_ended_lanes():
    rng = np.random.default_rng(21)
    counts = rng.integers(0, 50, 60).astype(float)
    layout = lm_scoring.Layout.of(counts)
    w = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in lm_scoring.initial_weights(counts, layout).items()}
    before, target = rng.integers(0, 60, (2, 5, 2))
    fresh, h = np.zeros((5, 2), bool), rng.normal(size=(2, lm_scoring.HIDDEN))
    live = np.ones((5, 2), bool)
    live[3:, 1] = False
    got, _ = lm_scoring._gradients(w, layout, before, target, fresh, h, live)
    a, _ = lm_scoring._gradients(w, layout, before[:, :1], target[:, :1], fresh[:, :1], h[:1])
    b, _ = lm_scoring._gradients(w, layout, before[:3, 1:], target[:3, 1:], fresh[:3, 1:], h[1:])
    for k in w:
        assert np.allclose(got[k], (5 * a[k] + 3 * b[k]) / 8, atol=1e-5)


def test_gradients_of_the_network():
    rng = np.random.default_rng(12)
    counts = rng.integers(1, 50, 40).astype(float)
    layout = lm_scoring.Layout.of(counts)
    w = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in lm_scoring.initial_weights(counts, layout).items()}
    before, target = rng.integers(0, 40, (5, 3)), rng.integers(0, 40, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[2, 1] = True

    def loss(w):
        h, total = np.zeros((3, lm_scoring.HIDDEN)), 0.0
        for t in range(5):
            *_, h = lm_scoring._step(w, before[t], np.where(fresh[t][:, None], 0, h))
            total -= lm_scoring.log_chances(w, layout, h, target[t]).sum()
        return total / 15

    g, _ = lm_scoring._gradients(w, layout, before, target, fresh, np.zeros((3, lm_scoring.HIDDEN)))
    for k in w:
        for at in [tuple(rng.integers(0, s) for s in w[k].shape) for _ in range(6)]:
            high, low = ({**w, k: w[k].copy()} for _ in range(2))
            high[k][at] += 1e-5
            low[k][at] -= 1e-5
            assert abs((loss(high) - loss(low)) / 2e-5 - g[k][at]) < 1e-5, k


def test_network_gives_chances():
    counts = np.arange(1.0, 60.0)
    layout = lm_scoring.Layout.of(counts)
    w = lm_scoring.initial_weights(counts, layout)
    h = np.random.default_rng(13).normal(size=(1, lm_scoring.HIDDEN)).astype(np.float32)
    every = lm_scoring.log_chances(w, layout, np.repeat(h, 59, axis=0), np.arange(59))
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_language_model(spark):
    rng = random.Random(14)
    chain = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def walk(n):
        out = ["a"]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return " ".join(out) + f" rare{rng.randrange(40)}"

    texts = [walk(rng.randint(20, 120)) for _ in range(500)]
    docs = edge_docs(spark, texts)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = lm_scoring.score_documents(docs, held).collect()
    all_texts = [*EDGES, *texts]
    tokens = {i: [*WORD.findall(ascii_lower(t or "")), ""] for i, t in enumerate(all_texts)}
    c = Counter()
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(words * 2)  # every row is there twice
    n, v = sum(c.values()), len(c)
    assert len(found) == docs.count()
    for r in found:
        words = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in c for w in words), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    new = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in new) > 0.9 * sum(r["base_score"] for r in new)
    # the model does not depend on how the rows are dealt
    score = {(r["doc_id"], r["score"]) for r in found}
    for parts in (2, 8):
        for r in lm_scoring.score_documents(docs.repartition(parts), held).collect():
            assert min(abs(r["score"] - s) for i, s in score if i == r["doc_id"]) < 1e-5 * abs(r["score"])
    assert lm_scoring.score_documents(docs.limit(0), held).count() == 0
    assert all(r["score"] == r["base_score"] for r in lm_scoring.score_documents(docs.limit(3), F.lit(True)).collect())


def test_workers_of_the_language_model_hold_little_memory(spark, monkeypatch):
    from pyspark.sql import functions as F

    works, words = [], [f"w{i}" for i in range(60_000)]
    docs = edge_docs(spark, [" ".join(words[i : i + 100]) for i in range(0, 60_000, 100)])
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, *a, **b: works.append(work) or plain(self, work, *a, **b))
    lm_scoring.score_documents(docs, F.lit(False))
    count, score = works[0], works[-1]
    rng = random.Random(23)
    texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(5000)])
    n = len(texts)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), texts], ["doc_row", "key", "held_out", "lm_text"])
    trim = ctypes.CDLL(None).malloc_trim

    def held():  # MB
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    for work, most in ((count, 110), (score, 190)):
        pa.default_memory_pool().release_unused()
        trim(0)
        before, peak, over = held(), [], threading.Event()

        def watch(peak=peak, over=over):
            while not over.wait(0.005):
                peak.append(held())

        watching = threading.Thread(target=watch)
        watching.start()
        made = sum(batch.num_rows for batch in work(iter([rows])))
        over.set()
        watching.join()
        assert made >= n
        assert held() - before < 25, "what a worker keeps between tasks"
        assert max(peak) - before < most


def test_pipeline(spark):
    import corpus_pipeline as C

    from stationloom.llm import secret_scan
    from stationloom.llm._shared import stored

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "pieces"]
    at = docs
    for name, stage in C.STAGES[:-1]:
        before, at = at, stored(stage(spark, at, sf), name)  # each stage is written and read again
        assert at.columns == docs.columns
        if name != "secrets":
            assert at.exceptAll(before).count() == 0 and at.count() <= before.count()
    assert secret_scan.scan_secrets(at).where("n_assign + n_access + n_hex > 0").count() == 0
    out = C.run(spark, sf)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
