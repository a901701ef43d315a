"""The operators against brute force on a small table with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, fingerprint, language, licenses, mixing, neardup, ngrams, quality, substrings, toxicity
from corpusloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, places string, row string"
EN = "the of and to in that is was for on are with as his they at be this from have".split()
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split()
RNG = random.Random(11)
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def prose(words, n):
    return " ".join(RNG.choice(words) + (str(RNG.randint(0, 99)) if RNG.random() < 0.3 else "") for _ in range(n))


def rows():
    base = prose(EN, 300)
    near = base.split()
    near[7] = "changed"
    texts = [base, base, " ".join(near), None, "", "a", "Released under the MIT License.", "x Apache License, Version 2. apache license VERSION 2 cc-by-nc", "12 34 !?",
             prose(FR, 200), prose(EN, 120) + " " + PASSAGE + "\n" + prose(EN, 60), PASSAGE.replace(" ", "\n", 3) + " tail", prose(FR, 80) + "\t" + PASSAGE, "\n\n" + prose(EN, 4000),
             "same line here\nsame line here\nsame line here\n" * 30, "日本語 text <|endoftext|> don't  \n x" + " " * 3, "é" * 400 + "a" * 700, "w " * 60]
    texts += [prose(EN if i % 2 else FR, 40 + i) for i in range(24)]
    out = [(i, t, None if i == 9 else "fr" if t and "être" in t else "en", None if i % 11 == 3 else f"s{i % 3}", len(t or ""), "s", "p", "r") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id at all", "en", "s1", 12, "s", "p", "r")]


ROWS = rows()
KNOWN = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def paragraphs(spark, texts):
    """The set of digests of each text, without a sketch: distinct pieces, repetitions apart."""
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    return {r["t"]: set(r["k"]) for r in df.select("t", fingerprint.digests(F.col("t")).alias("k")).collect()}


def like(a, b):
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def test_fingerprints(spark, docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, r in enumerate(order):
        own, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(own) // 2
        want.append((r[0], own, own[: len(own) - h] + nxt[:h], nxt))
    keys = paragraphs(spark, [t for _, *ts in want for t in ts])
    rows = Counter((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(like(keys[own], keys[edited]), 9), round(like(keys[own], keys[nxt]), 9), len(keys[own] - keys[edited])) for i, own, edited, nxt in want)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["n_removed_paragraphs"]) for r in got) == rows
    prints = {}
    for r in got:
        text = {x[0]: x[1] or "" for x in ROWS}[r["doc_id"]]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints) and {r["tries_next"] for r in got} == {1, 2}
    assert fingerprint.fingerprints(none).isEmpty()


def test_stored_fingerprints_can_be_compared(spark):
    """The likeness comes from the fingerprints: read back from text, subtracted and peeled, they give the difference."""
    old = ". ".join(f"sentence {i}" for i in range(300))
    df = spark.createDataFrame([(old, old.replace("sentence 7.", "phrase 7.").replace("sentence 70.", ""))], "a string, b string")
    prints = df.select(*[fingerprint.serialised(fingerprint.sketch(fingerprint.digests(F.col(c)))).alias(c) for c in "ab"], *[fingerprint.digests(F.col(c)).alias(f"k{c}") for c in "ab"])
    assert prints.select(F.length("a"), F.length("b")).first()[0] == 28 * fingerprint.HASHES * fingerprint.CELLS
    r = prints.select("ka", "kb", fingerprint.peeled(fingerprint.subtracted(fingerprint.parsed(F.col("a")), fingerprint.parsed(F.col("b")))).alias("found")).first()
    assert {(x["n"], x["k"]) for x in r["found"]} == {(1, k) for k in set(r["ka"]) - set(r["kb"])} | {(-1, k) for k in set(r["kb"]) - set(r["ka"])} and r["found"]


def test_long_pages_of_repeated_lines_end_soon(spark):
    page = "the same line\n" * 40_000
    df = spark.createDataFrame([(1, page, page + "one more line\n"), (2, "".join(f"line {i}\n" for i in range(9000)), "")], "id int, old string, new string")
    began = time.time()
    got = {r["id"]: r for r in fingerprint.diff_versions(df, "old", "new").collect()}
    assert time.time() - began < 60
    assert (len(got[1]["removed_digests"]), len(got[1]["added_digests"])) == (0, 1) and len(got[2]["removed_digests"]) == 9000


def test_ranges_of_ids(spark):
    """The next text is right whatever the number of ranges, for uneven, repeated and missing ids."""
    rng = random.Random(4)
    ids = [rng.choice([rng.randrange(50), rng.randrange(10**15), -rng.randrange(10**6)]) for _ in range(300)] + [None, 3, 3]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    for quantiles, size in ((2, 1 << 40), (7, 200), (512, 64 << 20)):
        got = {r["text"]: (r["doc_id"], r["next_text"]) for r in fingerprint.with_next(df, quantiles, size).collect()}
        at, seen = next(t for t, (i, _) in got.items() if i == max(x for x in ids if x is not None)), []
        for _ in ids:
            seen.append(got[at][0])
            at = got[at][1]
        assert seen == sorted([i for i in ids if i is not None], reverse=True) + [None] and len(got) == len(ids)


def test_recovered_digests(spark):
    df = spark.createDataFrame([(1, "a.b.b.c.", "a.b.d."), (2, None, "x\ny"), (3, "", ""), (4, ".".join(map(str, range(3000))), ".".join(map(str, range(1500, 4500))))], "id int, old string, new string")
    got = {r["id"]: r for r in fingerprint.diff_versions(df, "old", "new").collect()}
    assert [(len(got[i]["removed_digests"]), len(got[i]["added_digests"])) for i in (1, 2, 3)] == [(2, 1), (0, 2), (0, 0)]
    own = df.select("id", fingerprint.digests(F.col("old")).alias("a"), fingerprint.digests(F.col("new")).alias("b"))
    for r in own.collect():
        assert set(got[r["id"]]["removed_digests"]) == set(r["a"]) - set(r["b"]) and set(got[r["id"]]["added_digests"]) == set(r["b"]) - set(r["a"])


def test_retries_are_sized_by_the_difference(spark):
    """The estimate follows the differing digests, not the length of the texts, and is at most both sides' number."""
    pieces = [f"sentence {i}" for i in range(2000)]
    edited = lambda n: ". ".join(["phrase" + p for p in pieces[:n]] + pieces[n:])
    df = spark.createDataFrame([(n, ". ".join(pieces), edited(n)) for n in (0, 30, 200, 2000)], "n int, a string, b string")
    df = df.select("n", *[fingerprint._elements(fingerprint.digests(F.col(c))).alias(c) for c in "ab"])
    cells = fingerprint.subtracted(fingerprint._cells(F.col("a")), fingerprint._cells(F.col("b")))
    got = {r["n"]: r["d"] for r in df.select("n", fingerprint.estimated(cells, F.col("a"), F.col("b")).alias("d")).collect()}
    assert got[0] == 0 and 30 < got[30] < 160 and 200 < got[200] < 1000 and 2000 < got[2000] <= 4000


def test_licenses(docs, none):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for r in ROWS:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = pattern.findall(low)
        starts, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        g = got[r[0]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(starts), ",".join(sorted(labels)))
        assert (g["first_word"], g["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert licenses.scan(none).isEmpty()


def test_shifted_license_text(spark):
    t = licenses.TEMPLATES[0][0].split()
    t[9:9] = ["really"]
    del t[15]
    del t[100:110]
    got = licenses.scan(spark.createDataFrame([(1, "lead " + " ".join(t)), (2, "This work is licensed under the GNU General Public License, version 3.")], "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "mit", 2: "gpl-3"}


def shingled(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def classes(pairs):
    own = {r[0]: shingled(r[1] or "") for r in pairs}
    label = {k: k for k in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if a < b and own[a] != {()} and own[b] != {()} and len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs.select("doc_id", "text", "row", "score")).collect()
    assert len(got) == len(ROWS)
    want = classes(KNOWN)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    kept = [r["doc_id"] for r in got if r["is_kept"] and r["doc_id"] is not None]
    assert sorted(kept) == sorted(set(want.values())) and 0 in kept
    assert neardup.near_duplicates(none).isEmpty()
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(set(want.values())) + 1


def test_links_beside_the_pivot(spark):
    """A chain of texts, each like the next but not like the ones after it, is one class."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(200)] = f"n{rng.random()}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes([(i, t) for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == want


def test_links_of_texts_pasted_several_times(spark):
    """A text and the same text two, three and five times over have nearly equal sets, however often a shingle occurs."""
    rng = random.Random(17)
    texts = []
    for i in range(24):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60 + i))
        texts += [base, " ".join([base] * (2, 3, 5)[i % 3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes([(i, t) for i, t in enumerate(texts)])
    assert len(set(want.values())) == 24
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == want


def test_darts_agree_as_often_as_the_weights():
    rng = np.random.default_rng(5)
    elements = rng.integers(1, 2**63, 600, dtype=np.uint64)
    a, b = rng.integers(0, 6, 600), rng.integers(0, 6, 600)
    of = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    s = neardup.signatures(of, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    wa, wb = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0), np.where(b > 0, 1 + np.log(np.maximum(b, 1)), 0)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, 3), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


@pytest.mark.parametrize("most", [0, 2])
def test_ngrams(docs, none, monkeypatch, most):
    def tokens(t):
        return [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), None]

    train = [tokens(r[1]) for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(x for t in train for x in t)
    pairs = Counter((a, b) for t in train for a, b in zip([0, *t], t, strict=False))
    total, distinct = sum(c.values()), len(c)
    d = ngrams._discounts([sum(v == i for v in pairs.values()) for i in (1, 2, 3, 4)])
    after = Counter(b for _, b in pairs)
    seen = [sum(v == i for v in after.values()) for i in (1, 2, 3, 4)]
    low_d = ngrams._discounts(seen)
    left = (low_d[0] * seen[0] + low_d[1] * seen[1] + low_d[2] * (len(after) - seen[0] - seen[1])) / len(pairs)
    context, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        kinds[a, min(n, 3)] += 1
    less = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)

    def p(a, b):
        low = less(after[b], low_d) / len(pairs) + left / (distinct + 1)
        return low if not context[a] else less(pairs[a, b], d) / context[a] + sum(d[i] * kinds[a, i + 1] for i in range(3)) / context[a] * low

    assert abs(sum(p(b"the", b) for b in c) + p(b"the", b"never seen") - 1) < 1e-9
    if most:  # counts from here on stand apart
        monkeypatch.setattr(ngrams, "MOST", most)
    layout = ngrams.fit(docs.where("doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2))
    for r in ngrams.score(docs.select("doc_id", "text", "score"), layout).collect():
        t = tokens({x[0]: x[1] for x in ROWS}[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[x] > 0 for x in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip([0, *t], t, strict=False)), rel_tol=1e-9)
    assert ngrams.score(none, ngrams.fit(none)).isEmpty()
    assert ngrams.score(docs, ngrams.fit(none)).count() == len(ROWS)


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    text = {r[0]: r[1] or "" for r in ROWS}
    got = bpe.roundtrip(docs, with_ids=True)
    assert got.columns[:2] == ["doc_id", "lang"]
    for r in got.collect():
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.roundtrip(none).isEmpty()


def test_bpe_random_texts():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = random.Random(8)
    letters = "aaeioustrn  '\n\t019.,-éß漢🙂İ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    coder = bpe.Codec(bpe.default_path())
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids and coder.decode(ids) == t


def removed(pairs, window, doc_id, text):
    """Words, removed words and the digest of what is left of one row, by brute force."""
    words = (text or "").encode().split()
    before = set()
    for i, t in pairs:
        if i < doc_id:
            other = (t or "").encode().split()
            before |= {tuple(other[k : k + window]) for k in range(len(other) - window + 1)}
    gone = [False] * len(words)
    for k in range(len(words) - window + 1):
        if tuple(words[k : k + window]) in before:
            gone[k : k + window] = [True] * window
    return len(words), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(words, gone, strict=True) if not g)).hexdigest()


def test_substrings(docs, none):
    pairs = [(r[0], r[1]) for r in KNOWN]
    want = {i: removed(pairs, 50, i, t) for i, t in pairs}
    got = substrings.dedup(docs)
    assert "text" not in got.columns and got.count() == len(ROWS)
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert substrings.dedup(none).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_substrings_small_alphabet(spark, seed):
    """Periodic texts, many equal windows, several rows of one id with different texts."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [texts[3] + " " + texts[5], texts[7][10:], "a " * 200, "a b " * 70, "x " + "a b " * 30, texts[3]]
    pairs = [(i if i % 5 else i // 10, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = Counter((i, *removed(pairs, 12, i, t)) for i, t in pairs)
    assert Counter(tuple(r) for r in substrings.dedup(df, window=12).collect()) == want
    assert max(len([1 for p in pairs if p[0] == i]) for i, _ in pairs) > 1


def test_substrings_are_located_by_the_automaton(spark, monkeypatch):
    """Without what the automaton reports nothing is removed."""
    df = spark.createDataFrame([(i, f"own{i} " + PASSAGE) for i in range(3)], "doc_id long, text string")
    rows = pd.DataFrame({"doc_id": [1], "text": ["own1 " + PASSAGE], "op6_places": [None]})
    assert [r["n_removed"] for r in substrings.dedup(df).orderBy("doc_id").collect()] == [0, 70, 70]
    assert next(substrings._remove(50, False, ["doc_id"])(iter([rows])))["n_removed"].tolist() == [0]
    shard = substrings.Shard([b"x a b c d e f g h y", b"a b c d e f g h"], [b"a b c d e f g h"])
    assert shard.located(np.array([0, 10, 18])).tolist() == [-1, 0] + [-1] * 8 + [0] + [-1] * 7


def test_quality(docs, none):
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in quality.assess(docs).collect():
        t = text[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = {}
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.assess(none).isEmpty()


def test_common_lines(spark):
    rng = random.Random(6)
    own = lambda: " ".join(f"u{rng.random()}" for _ in range(60))
    menu = "Home | About 2024 | " + " ".join(f"menu{i}" for i in range(70))
    texts = [own() + "\n" + menu for _ in range(15)] + [own() for _ in range(30)] + [menu.replace("2024", "1999") for _ in range(8)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df, least=10, share=0.2, rest=0.4).collect()}
    assert all(got[i]["n_common_lines"] == 1 for i in range(15)) and all(got[i]["kept"] for i in range(45))
    assert not any(got[i]["kept"] for i in range(45, 53)), "nothing is left of them"
    clean = {r["doc_id"]: r["text"] for r in quality.cleaned(df, least=10, share=0.2).collect()}
    assert clean[0] == texts[0].split("\n")[0] and clean[50] == "" and clean[20] == texts[20]


def test_language(docs, none):
    model = language.learn(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 8)] == ["und"] * 3 and got[9]["lang_pred"] == "fr" and got[13]["lang_pred"] == "en"
    right = [got[r[0]]["lang_pred"] == r[2] for r in KNOWN[18:42]]
    assert sum(right) == len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and set(docs.columns) - {"score"} <= set(language.identify(docs, model).columns)
    assert language.identify(docs, language.learn(none)).where("lang_pred <> 'und'").isEmpty() and language.identify(none, model).isEmpty()


@pytest.mark.parametrize("dense_bytes", [128 << 20, 0])
def test_every_letter_has_its_code(monkeypatch, dense_bytes):
    """Languages are told apart by letters behind the first 250, also beyond the basic plane and for any form of the automata."""
    monkeypatch.setattr(language, "DENSE_BYTES", dense_bytes, raising=False)
    rng = random.Random(2)
    first = {"aa": 0x100, "ko": 0xAC00, "xx": 0x20000, "yy": 0x21000, "zh": 0x4E00}
    letters = {k: [chr(c) for c in range(a, a + 300)] for k, a in first.items()}
    text = {k: ["".join(rng.choice(x) for _ in range(800)) for _ in range(2)] for k, x in letters.items()}
    got, _ = language.Model({k: t[0] for k, t in text.items()}).predict([t[1] for t in text.values()])
    assert got == list(first)


def test_lists_and_tables_of_transitions_agree(monkeypatch):
    rng = random.Random(4)
    samples = {k: "".join(rng.choice(x) for _ in range(500)) for k, x in (("a", "abc "), ("b", "cdé "))}
    texts = ["".join(rng.choice("abcdéfA ,") for _ in range(n)) for n in (1, 7, 300, 1000)]
    dense = language.Model(samples)
    monkeypatch.setattr(language, "DENSE_BYTES", 0)
    listed = language.Model(samples)
    assert type(dense.tables[0]) is not type(listed.tables[0])
    assert (dense.phrases(texts)[0] == listed.phrases(texts)[0]).all()


def test_every_labelled_language_is_learned(spark):
    rows = [(f"l{i:02}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(20))) for i in range(70)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.learn(df)
    assert model.languages == [r[0] for r in rows]
    assert model.predict([r[1] for r in rows])[0] == model.languages


def test_cross_parsing_is_exact():
    """Phrases are those of one parse of the whole text, also where they run over several pieces."""
    rng = random.Random(1)
    sample = "".join(rng.choice("abc ") for _ in range(5000))
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (1, 390, 1700)]
    texts += [sample[100:4100], sample[7:1500] + "d" + sample[2000:4000], sample[:900] * 3, ""]
    model = language.Model({"x": sample})

    def brute(text):
        train, seq = bytes(language.coded(sample, model.codes)), bytes(language.coded(text, model.codes))
        n, at = 0, 0
        while at < len(seq):
            size = 1
            while at + size < len(seq) and seq[at : at + size + 1] in train:
                size += 1
            n, at = n + 1, at + size
        return n

    got = model.phrases(texts)[0][:, 0].tolist()
    assert got == [brute(t) for t in texts] and got[3] == 1


def test_mixing(spark, docs, none):
    got = mixing.mixed(docs, keep=0.5).collect()
    assert len(got) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in got)
    assert all(len({r["is_kept"] for r in got if r["doc_id"] == i}) == 1 for i in range(5))
    assert mixing.mixed(none).isEmpty() and set(mixing.sampled(docs).columns) == set(docs.columns)
    cells = spark.createDataFrame([("a", "en", "t", 700), ("a", "fr", "t", 100), ("b", "en", "u", 150), ("b", "fr", "t", 50), ("a", "en", "u", 100)], "source string, lang string, topic string, tokens long")
    target = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"t": 0.7, "u": 0.3}}
    raked = mixing.rake(cells, targets=target)
    for d, want in target.items():
        for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] - want[r[d]]) < 1e-6
    assert raked.agg(F.max("residual")).first()[0] <= mixing.TOLERANCE
    for keep in (0.1, 0.5, 0.95, 1.0):
        p = mixing.calibrated(raked, keep)
        assert p.where("probability NOT BETWEEN 0 AND 1").isEmpty()
        assert abs(p.agg((F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).alias("s")).first()["s"] - keep) < 1e-6
    impossible = mixing.rake(cells.where("source = 'a'"), targets={"source": {"b": 1.0}})
    assert impossible.count() == 3


def test_mixing_leaves_columns_alone(spark):
    """Columns of the names that the operator uses itself come back as they were; repeated and empty rows follow their id."""
    rows = [(i % 30, None if i == 4 else "a b " * (i % 7), "en", None, f"t{i}", "x", f"p{i}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, tokens string, probability string, row long")
    got = mixing.sampled(df, keep=0.6, topic=F.col("topic"))
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(rows) and 0 < len(kept) < len(rows)
    chosen = {r["row"] for r in df.withColumn("k", F.lit(0)).collect()} & {r[7] for r in kept}
    assert len(chosen) == len(kept)


def test_toxicity(spark, none):
    rng = random.Random(9)
    data = []
    for i in range(400):
        bad = i % 5 == 0
        w = [rng.choice(EN) + str(rng.randint(0, 50)) for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "MORON!", "scum"])
        data.append((i, " ".join(w), int(bad), "s"))
    df = spark.createDataFrame([*data, (900, None, None, "s"), (901, "", 0, "s"), (902, "you 1d1ot", 1, "s")], "doc_id long, text string, toxic int, score string")
    model = toxicity.fit_model(df, df.where("doc_id % 4 <> 2"))
    assert {"idiot", "moron", "scum"} <= set(model.words)
    got = {r["doc_id"]: r["score"] for r in model.score(df).collect()}
    assert len(got) == 403 and all(0 <= x <= 1 for x in got.values())
    held = [(got[i], y) for i, _, y, _ in data if i % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    assert toxicity.Lexicon(["idiot"]).code("1d1ot") == 4 and toxicity.Lexicon(["idiot"]).code("Idiot,") == 1
    empty = toxicity.fit_model(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert empty.score(df).where("score <> 0").isEmpty()


def brute_features(words, text):
    """The features of one text, spelled out word by word."""
    text = text or ""
    tier = {w: 1 + 3 * i // len(words) for i, w in enumerate(words)}
    tokens = text.split()
    edge = lambda w: w.lower().strip(".,;:?!\"'()[]{}<>|*#%&$-_/\\")
    bare = lambda w: re.sub(r"(.)\1{2,}", r"\1", w.lower().translate(toxicity._SWAPPED)).strip(".,;:?!\"'()[]{}<>|*#%&$-_/\\")
    hits, found, mixed, tiers = [], [], 0, [0, 0, 0]
    second = [i for i, w in enumerate(tokens) if edge(w) in toxicity.SECOND_PERSON and edge(w) not in tier]
    for i, w in enumerate(tokens):
        low = edge(w)
        t, under = tier.get(low), False
        if t is None and i not in second and (not low.isalpha() or re.search(r"([^\W\d_])\1\1", low)):
            t, under = tier.get(bare(w)), True
        if t:
            hits.append(i)
            tiers[t - 1] += 1
            found.append((low, under))
        elif not low.isalpha() and i not in second:
            inner = re.sub("[-'’]", "", low)
            mixed += any(c.isalpha() for c in inner) and not inner.isalpha()
    gaps = [min(abs(i - j) for j in second) for i in hits] if second else []
    d, n = max(len(tokens), 1), max(len(text), 1)
    count = lambda letters: sum(text.count(c) for c in letters)
    capitals = sum(c.isascii() and c.isupper() for c in text)
    return [
        len(tokens), len(hits), len(hits) / d, tiers[0], tiers[0] / d, tiers[1], tiers[1] / d, tiers[2] / d, len({w for w, _ in found}), hits[0] / d if hits else 1.0,
        len(second) / d, min([99, *gaps]), sum(g <= 5 for g in gaps) / d, capitals / n, sum(len(w) > 2 and w.isupper() for w in tokens) / d if capitals > 2 else 0.0, count("!\"'(),-.:;?") / n, count("!") / n, count("?") / n, count("#$%&*<>@|") / n,
        sum(u for _, u in found) / d, mixed / d, len(re.findall(r"([^\W\d_])\1\1", text)) / d, len(toxicity._SPACED.findall(text)) / d,
    ]


def test_toxicity_against_brute_force(spark):
    """Features, lexicon, calibration and the query's columns."""
    rng = random.Random(12)
    insults = ["idiot", "moron", "scum", "fool", "trash", "creep"]
    data = [(None, 0), ("", 0), ("You 1d1ot!! MORON you, f o o l", 1), ("heeeello don't x2y *** scuuum IDIOT?", 1), ("a " * 5000 + "trash you", 1)]
    for i in range(300):
        w = [rng.choice(EN) + str(rng.randint(0, 30)) for _ in range(30)] + ["you"] * (i % 3)
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(insults).upper() if i % 8 else rng.choice(insults)
        data.append((" ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(data)], "doc_id long, text string, toxic int")
    words = [*insults, "you"][:6]
    got = {r["doc_id"]: [r[f"f_{n}"] for n in toxicity.FEATURES] for r in toxicity.with_features(df, words).collect()}
    for i, (t, _) in enumerate(data):
        assert np.allclose(got[i], brute_features(words, t)), (i, t)

    sample = [(t or "", y) for t, y in data]
    n1, n = sum(y for _, y in sample), len(sample)
    seen = Counter((w, y) for t, y in sample for w in {re.sub(r"^[\W_]+|[\W_]+$", "", x.lower()) for x in t.split()} if len(w) > 1)
    z = {}
    for w in {w for w, _ in seen}:
        a, b = seen[w, 1] + 0.5, seen[w, 0] + 0.5
        if seen[w, 1] >= 3:
            z[w] = (math.log(a / (n1 - seen[w, 1] + 0.5)) - math.log(b / (n - n1 - seen[w, 0] + 0.5))) / math.sqrt(1 / a + 1 / b)
    want = sorted((w for w in z if z[w] > 3), key=lambda w: (-z[w], w))
    assert set(insults) & set(toxicity.learn_lexicon(df)) and set(toxicity.learn_lexicon(df)) == set(want)

    model = toxicity.fit_model(df, df.select("doc_id", "toxic").unionByName(df.select("doc_id", F.lit(0).alias("toxic"))))
    scores = {r["doc_id"]: r["score"] for r in model.score(df).collect()}
    raw = {r["doc_id"]: r["raw_score"] for r in toxicity._raw_score(model.trees, toxicity.with_features(df, model.words)).collect()}
    for i in scores:
        assert math.isclose(scores[i], min(max(np.interp(raw[i], model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()), 0), 1), abs_tol=1e-9)
    order = sorted(scores, key=raw.get)
    assert all(scores[a] <= scores[b] + 1e-12 for a, b in zip(order, order[1:], strict=False)), "calibration keeps the order"
