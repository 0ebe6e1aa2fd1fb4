"""URL filters, quality rules, secrets, licences, decontamination: plain versions and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stationloom.llm import decontamination as D
from stationloom.llm import license_scan as L
from stationloom.llm import quality_rules as Q
from stationloom.llm import secret_scan as S
from stationloom.llm import url_filter as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " ", "\n\n", "a", "é ü\x0bß", "x" * 50_000, "the same\nthe same\nthe same", "\x00 \u2581 \ue581"]


def edge_docs(spark, more=()):
    """Edge texts twice, with columns whose names the operators use inside."""
    rows = [(i, t, 1, 2, 3, 4) for i, t in enumerate([*EDGES, *more])]
    return spark.createDataFrame(rows + rows, "doc_id long, text string, key int, score int, row int, lines int")


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://a.NET", "http://a.NET/", "x://example.net/en/a?b", "x://example.net/en", "x://sub.example.com/de/x#y",
        "x://notexample.com/de/x", "x://a.org/fr/", "x://org/fr/z", "x://a.org/de/", "x://example.net?q/en/", "x://net", "x://e.net/a://b",
    ]
    pages = spark.createDataFrame([(i % 16, u, "x", "y") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, rule string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    for rules in (U.RULES, U.rule_table(spark, U.RULES)):
        found = U.filter_urls(pages, rules).collect()
        assert Counter(map(tuple, found)) == Counter((i % 16, *plain(u)) for i, u in enumerate(urls + urls))
    assert {r["verdict"] for r in U.filter_urls(pages, []).collect()} == {"allow"}
    assert U.filter_urls(pages.limit(0), U.RULES).count() == 0


def test_equal_length_rules(spark):
    page = spark.createDataFrame([(1, "x://b.aa/c")], "page_id long, url string")
    assert U.filter_urls(page, [("aa", "/c", "allow"), ("b.aa", "/", "block"), ("aa", "/c", "block")]).first()["rule"] == "b.aa/"
    assert U.filter_urls(page, [("aa", "/c", "allow"), ("aa", "/c", "block")]).first()["verdict"] == "block"


def plain_counts(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(Q.SYMBOLS, text)), dup, len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab# \n\té|") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    docs = edge_docs(spark, texts)
    found = Q.judge_quality(docs, None).collect()
    assert len(found) == docs.count()
    for r in found:
        counts = plain_counts((EDGES + texts)[r["doc_id"]] or "")
        assert tuple(r)[1:6] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r["kept"] == (not r["base_failed"])
    assert Q.judge_quality(docs.limit(0), None).count() == 0
    kept = Q.filter_quality(docs, None)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)


def test_trees_learn_and_keep_their_direction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.2)).astype(float)
    trees = Q.fit_trees(x[:2000], y[:2000], [-1, 0, 0])
    assert ((trees.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.97
    line = np.tile(x[:50], (40, 1))
    line[:, 0] = np.repeat(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.score(line).reshape(40, 50), axis=0) <= 1e-12).all()


def test_fit_on_a_bounded_sample(spark):
    rng = random.Random(17)
    rows = [(i % 900, " ".join(rng.choice(["word", "#", "line"]) + str(rng.randrange(60 if i % 2 else 4)) for _ in range(70))) for i in range(1800)]
    docs = spark.createDataFrame(rows + [rows[5]] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] + [(7, 1)] * 50, "doc_id long, quality int")
    seen = []
    import stationloom.llm.quality_rules as Q2

    original = Q2.fit_trees
    try:
        Q2.fit_trees = lambda x, y, signs: seen.append((len(y), y.mean())) or original(x, y, signs)
        models = [Q.fit_quality(docs.repartition(n), labels.repartition(n), rows=200) for n in (1, 5)]
        Q.fit_quality(docs, labels)
    finally:
        Q2.fit_trees = original
    assert seen[0] == seen[1] and 150 <= seen[0][0] <= 200 and seen[2][0] == 900
    assert all(np.array_equal(getattr(models[0], f), getattr(models[1], f)) for f in ("feature", "threshold", "value"))


def test_fit_wants_both_classes(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert Q.fit_quality(docs, labels) is None and Q.fit_quality(docs, labels.limit(0)) is None


def plain_secrets(text):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans, at = [], 0
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    while m := assign.search(lower, at):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
        at = m.end()
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets(spark):
    rng = random.Random(3)
    pieces = ["Token", "api_key", "apiKey", "secret", "=", ": ", '"', "AKIA", "ABCDEF1234567890", "0123456789abcdef", "é", " ", "\n", "passwd", "toſken", "x" * 12, "Kelvin"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)]
    docs = edge_docs(spark, texts)
    for r in S.scan_secrets(docs).collect():
        base = plain_secrets((EDGES + texts)[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base]
    assert S.scan_secrets(docs.limit(0)).count() == 0
    clean = S.redact_secrets(docs)
    assert clean.columns == docs.columns and S.scan_secrets(clean).agg({"n_assign": "sum", "n_access": "sum", "n_hex": "sum"}).first()[1] == 0


def test_novel_secrets():
    key = "Zk39xQpL7vTn2RwY8sJd"
    text = f"the auth value is {key} here"
    assert S.find_secrets(text) == [(18, 3, 38)]
    assert S.find_secrets(f"{key} said before, and the auth value is {key}") == []  # known from around
    assert S.find_secrets(f"the value is {key} here") == [] and S.find_secrets("auth: example-1-example-example") == []


def plain_novel(text):
    """Every candidate by hand: where it starts, where it ends, and whether it is judged new."""
    near = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    ends = {i + len(w) for w in S.SENSITIVE.split("|") for i in range(len(text)) if lower.startswith(w, i)}
    base, out = plain_secrets(text), []
    for i in range(len(text)):
        if text[i] not in near or i and text[i - 1] in near:
            continue
        end = i
        while end < len(text) and text[end] in near:
            end += 1
        if end - i < 16 or not any(e <= i <= e + S.REACH and "\n" not in text[e:i] for e in ends):
            continue
        pads = 0
        while end + pads < len(text) and text[end + pads] == "=":
            pads += 1
        if 1 <= pads <= 2 and (end + pads == len(text) or text[end + pads] not in near):
            end += pads
        run = text[i:end]
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        if mixed and not any(a < end and i < b for a, _, b in base):
            around = text[max(0, i - S.AROUND) : i] + text[end : end + S.AROUND]
            if S.marginal_bytes(run, around) >= S.NOVEL_SHARE * len(run):
                out.append((i, 3, end))
    return out


def test_every_novel_candidate():
    rng = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    new = lambda: "".join(rng.choices(letters, k=rng.randint(14, 40)))
    pieces = ["auth", "Key", "private_key=", "credential", " ", " ", " ", "\n", "is", ": ", "=", "==", "&", '"', "configuration-identifier", "configurationvalues", "x" * 20, "0123456789abcdef", "token=", "é", "ſ"]
    found = 0
    for _ in range(1500):
        text = "".join(new() if rng.random() < 0.25 else rng.choice(pieces) for _ in range(rng.randint(2, 14)))
        got = [s for s in S.find_secrets(text) if s[1] == 3]
        assert got == plain_novel(text), text
        assert [s for s in S.find_secrets(text) if s[1] < 3] == plain_secrets(text)
        assert S._scan(pa.array([text], pa.large_string())) == [S.find_secrets(text)]
        found += len(got)
    assert found > 300
    key, other = "Zk39xQpL7vTn2RwY8sJd", "Qm48wLpR6xUn3SvZ9tKe"
    assert len(S.find_secrets(f"auth value is {key} and {other}")) == 2 and len(S.find_secrets(f"auth configurationvalues {key}")) == 1


def test_novel_secrets_behind_equals_and_other_runs():
    key = "Zk39xQpL7vTn2RwY8sJd"
    names = ["AWS_SECRET_ACCESS_KEY", "access_key", "auth", "private_key", "export signature", "?a=b&auth"]
    for name in names:
        at = len(name) + 1
        assert S.find_secrets(f"{name}={key}\nend") == [(at, 3, at + len(key))]
        assert S.find_secrets(f"{name}={key}==\nend") == [(at, 3, at + len(key) + 2)]
        assert S.redacted(f"{name}={key}", S.find_secrets(f"{name}={key}")) == f"{name}=[REDACTED]"
    behind = "key configuration-identifier "
    assert S.find_secrets(behind + key) == [(len(behind), 3, len(behind) + len(key))]
    assert S.find_secrets("key" + " " * 40 + key) == [(43, 3, 63)]
    assert S.find_secrets("key" + " " * 41 + key) == [] and S.find_secrets("key\n" + key) == []
    assert S.find_secrets("key " + "configuration_identifier_1=" + key)[-1][1:] == (3, 51)


def test_licenses(spark):
    files = [
        ("LICENSE", "Permission and more\nReleased under the MIT License."), ("a/x", "text"), ("a/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/b/y", "no word"), ("a/b/z", "This work is licensed under the GNU General Public License, version 3."), (None, None), ("c/d", "our licence is secret"), ("a/x", "text"),
    ]
    table = spark.createDataFrame([(i, p, t, "n") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, lines string")
    from pyspark.sql import functions as F

    named = F.col("path").rlike("(LICENSE|COPYING)$")
    found = {r["doc_id"]: (r["license"], r["how"], r["folder"]) for r in L.scan_licenses(table, "doc_id", F.col("path"), F.col("text"), named).collect()}
    assert found == {
        0: ("MIT", "own", None), 1: ("Apache-2.0", "inherited", "a"), 2: ("Apache-2.0", "own", None), 3: ("Apache-2.0", "inherited", "a"),
        4: ("GPL-3.0", "own", None), 5: ("MIT", "inherited", ""), 6: ("MIT", "inherited", ""), 7: ("Apache-2.0", "inherited", "a"),
    }
    assert L.scan_licenses(table.limit(0), "doc_id", F.col("path"), F.col("text"), named).count() == 0


def test_texts_of_licences(spark):
    from pyspark.sql import functions as F

    text = {}
    for name, t in L.TEXTS:
        text.setdefault(name, t)
    lines = lambda t, mark="": "\n".join(mark + t[i : i + 70] for i in range(0, len(t), 70)) if mark else t
    prose = "the river ran slowly past the old mill and the people of the town walked along it in the evening " * 15
    files = {
        "mit/LICENCE": "Copyright (c) 2020 Someone\n\n" + text["MIT"], "mit/a/x": "code", "bsd3/y": text["BSD-3-Clause"], "bsd2/y": text["BSD-2-Clause"], "isc/z": "ISC\n" + text["ISC"],
        "p/gpl3": "#!/bin/sh\n# Copyright 2020\n# " + text["GPL-3.0"].replace(". ", ".\n# ") + "\n" + prose, "p/gpl2": text["GPL-2.0"] + "\n" + prose, "p/lgpl": prose + text["LGPL-2.1"],
        "p/apache": "/* " + text["Apache-2.0"] + " */\n" + prose, "p/mpl": text["MPL-2.0"] + prose, "p/unlicense": text["Unlicense"],
        "p/spdx1": "// SPDX-License-Identifier: BSD-3-Clause\nint main;", "p/spdx2": "SPDX-License-Identifier: GPL-2.0-only", "p/spdx3": "/* SPDX-License-Identifier: LGPL-3.0-or-later */",
        "p/spdx4": "SPDX-License-Identifier: Foo-1.0", "p/prose": prose + "Released under the MIT License. " + prose, "p/none": prose + "the licence of the inn was lost, copyright was not known, " + prose,
    }
    table = spark.createDataFrame([(p, t, 1) for p, t in files.items()], "path string, text string, unit int")
    found = {r["path"]: (r["license"], r["how"]) for r in L.scan_licenses(table, "path", F.col("path"), F.col("text"), F.lit(False)).collect()}
    own = {
        "mit/LICENCE": "MIT", "bsd3/y": "BSD-3-Clause", "bsd2/y": "BSD-2-Clause", "isc/z": "ISC", "p/gpl3": "GPL-3.0", "p/gpl2": "GPL-2.0", "p/lgpl": "LGPL-2.1", "p/apache": "Apache-2.0",
        "p/mpl": "MPL-2.0", "p/unlicense": "Unlicense", "p/spdx1": "BSD-3-Clause", "p/spdx2": "GPL-2.0", "p/spdx3": "LGPL-3.0", "p/prose": "MIT",
    }
    assert {p: x[0] for p, x in found.items() if x[1] == "own"} == own
    assert found["mit/a/x"] == ("MIT", "inherited")  # a whole licence text speaks for its folder, whatever its name
    assert found["p/none"][1] != "own" and found["p/spdx4"][1] != "own"
    edges = edge_docs(spark)
    assert {r["how"] for r in L.scan_licenses(edges, "doc_id", F.lit(None).cast("string"), F.col("text"), F.lit(True)).collect()} == {"none"}


def bm25(index, words):
    """Scores of all parts, the plain way."""
    return [sum(w for t in set(words) for p, w in index.postings[t] if p == part) for part in range(len(index.parts))]


def test_wand_finds_all(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(120)], k=rng.randint(3, 30)))) for i in range(60)]
    index = D.build_index(items)
    for _ in range(150):
        passage = [t for t in range(len(index.terms)) if rng.random() < rng.choice([0.1, 0.3, 0.6])]
        for threshold in (0.3, 0.6):
            want = {p: s for p, s in enumerate(bm25(index, passage)) if s >= threshold - 1e-9}
            got = dict(D.wand(index, passage, threshold))
            assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_leaks(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.randint(15, 60))) for i in range(40)] + [(40, None), (41, ""), (42, say(300)), (43, say(20) + "? " + say(5))]
    texts = dict(items)
    docs = [say(200) for _ in range(60)]
    docs[3] += " " + texts[7].upper() + "! " + say(30)
    docs[5] = say(1000) + " " + texts[8].replace(" ", ", ") + " " + say(1000)
    docs[6] = texts[42]
    docs[7] += " " + texts[43].split("?")[0]  # the question without its answer
    docs[8] += " " + texts[43]
    frame = edge_docs(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"] - len(EDGES), r["item_id"]) for r in D.find_leaks(frame, bench).collect()}
    assert found == {(3, 7), (5, 8), (6, 42), (8, 43)}
    assert D.drop_leaks(frame, bench).count() == frame.count() - 8
    assert D.find_leaks(frame, bench.limit(0)).count() == 0 and D.find_leaks(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rounds_change_nothing(spark, monkeypatch, kind):
    rng = random.Random(15)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, weights=[1 / (k + 3) for k in range(400)], k=n))
    names = [f"i{i:03}" if kind == "string" else i for i in range(90)]
    items = [(names[i], say(rng.randint(8, 40)) + ("? " + say(4) if i % 3 == 0 else "") if i else say(300)) for i in range(90)]
    docs = [(i, " ".join([say(rng.randint(0, 80)), " ".join(t for t in items[i % 90][1].split() if rng.random() < 0.9), say(rng.randint(0, 80))])) for i in range(180)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, *items[:3], (None, items[4][1])], f"item_id {kind}, text string")
    found = []
    for at_once in (20_000, 31, 7):
        monkeypatch.setattr(D, "ITEMS_AT_ONCE", at_once)
        found.append(Counter(map(tuple, D.find_leaks(frame, bench).collect())))
        assert D.drop_leaks(frame, bench).count() == len(docs) - len({f[0] for f in found[-1]})
    assert len(found[0]) > 60 and type(next(iter(found[0]))[1]) is (str if kind == "string" else int)
    strip = lambda c: {(d, i, round(s, 9), q, a) for d, i, s, q, a in c}
    assert strip(found[0]) == strip(found[1]) == strip(found[2])


def plain_leaks(items, text, threshold=D.THRESHOLD):
    """All items found in a text: every window scored with plain BM25, and verified."""
    index = D.build_index(items)
    names = {v: k for k, v in index.terms.items()}
    words = re.findall(r"[^\W_]+", (text or "").lower())
    half, out = index.window // 2, {}
    n = max(-(-len(words) // half) - 1, 1) if words else 0
    for k in range(n):
        stop = len(words) if k == n - 1 else k * half + index.window
        here = words[k * half : stop]
        scores = bm25(index, [index.terms[w] for w in set(here) if w in index.terms])
        for part, score in enumerate(scores):
            if score < threshold - 1e-9:
                continue
            own = [names[t] for t in index.parts[part]]
            long = min(D.GRAM, len(own))
            grams = lambda ws: {tuple(ws[i : i + long]) for i in range(len(ws) - long + 1)}
            question = len(grams(here) & grams(own)) / len(grams(own))
            answer = {names[t] for t in index.answers[part]}
            behind = set(words[k * half : min(stop + index.reach[part], len(words))])
            share = len(answer & behind) / len(answer) if answer else 1.0
            if question >= D.QUESTION_SHARE and share >= D.ANSWER_SHARE:
                at = index.items[part]
                out[at] = max(out.get(at, (0, 0, 0)), (round(score, 9), question, share))
    return out


def test_leaks_against_a_plain_version(spark):
    rng = random.Random(16)
    vocab = [f"v{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, weights=[1 / (k + 2) for k in range(300)], k=n))
    items = [(i, say(rng.randint(3, 50)) + ("? " + say(rng.randint(1, 30)) if i % 2 else "")) for i in range(40)] + [(40, say(400))]
    texts = []
    for i in range(120):
        words = items[i % 41][1].split()
        kept = [w if rng.random() < 0.85 else rng.choice(vocab) for w in words][: rng.randint(len(words) // 2, len(words))]
        texts.append(" ".join([say(rng.randint(0, 300)), *kept, say(rng.randint(0, 300))]))
    frame = edge_docs(spark, texts)
    found = {}
    for r in D.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect():
        found.setdefault(r["doc_id"], {})[r["item_id"]] = (round(r["score"], 9), r["question_share"], r["answer_share"])
    want = {i: plain for i, t in enumerate([*EDGES, *texts]) if (plain := plain_leaks(items, t))}
    assert found == want and len(want) > 30


def leaked_items(index, words):
    return {f[1] for f in D.leaks_of(pa.array([" ".join(words)], pa.large_string()), index)}


@pytest.mark.parametrize("size", [255, 256, 300, 511])
def test_quotes_across_parts(size):
    other = [(k, " ".join(f"o{k}x{i}" for i in range(40))) for k in range(2, 30)]
    item = [f"q{i}" for i in range(size)]
    index = D.build_index([(1, " ".join(item)), *other])
    for at in range(size - 128 + 1):
        assert leaked_items(index, [*(f"n{i}" for i in range(at % 97)), *item[at : at + 128], *(f"m{i}" for i in range(200))]) == {1}


def test_a_short_tail_is_no_part():
    item = [f"q{i}" for i in range(129)]
    index = D.build_index([(1, " ".join(item)), (2, "some other words of an item")])
    assert min(map(len, index.parts[:-1])) == D.PART_WORDS
    assert leaked_items(index, ["text", "with", item[-1], "in", "it"]) == set()
    assert leaked_items(index, item) == {1}


@pytest.mark.parametrize("n_question, n_answer", [(64, 64), (20, 400), (128, 150), (200, 90)])
def test_long_answers_at_every_offset(n_question, n_answer):
    asked, told = [f"q{i}" for i in range(n_question)], [f"a{i}" for i in range(n_answer)]
    index = D.build_index([(1, " ".join(asked) + "? " + " ".join(told)), *((k, f"o{k} p{k} r{k} s{k} t{k} u{k}") for k in range(2, 30))])
    for at in range(0, index.window + 1):
        around = [f"n{i}" for i in range(at)], [f"m{i}" for i in range(600)]
        assert leaked_items(index, [*around[0], *asked, *told, *around[1]]) == {1}
    if n_question <= D.PART_WORDS:  # a question alone is no leak
        assert leaked_items(index, [*asked, *around[1]]) == set()


def test_arrow_text_is_whole():
    from stationloom.llm import _words as W

    batch = pa.RecordBatch.from_arrays([pa.array(["a B", None, "c", "D e " * 10])], ["t"])
    parts = [W.words_of(W.text_of(b, "t"), True)[1].to_pylist() for b in W.slices([batch], "t", 3)]
    assert parts == [["a", "b"], ["c"], ["d", "e"]] or parts == [["a", "b"], [], ["c"], ["d", "e"]]


def test_a_process_keeps_the_caches_of_one_operator(monkeypatch):
    from stationloom.llm import _words as W

    told = []
    monkeypatch.setattr(W, "FORGET", {n: (lambda n=n: told.append(n)) for n in ("a", "b")})
    batch = pa.RecordBatch.from_arrays([pa.array(["x"])], ["t"])
    assert len(list(W.slices([batch], "t", owner="a"))) == 1 and told == ["b"]
    assert len(list(W.slices([batch], "t"))) == 1 and told == ["b", "a", "b"]
