"""Phrase mining, suffix dedup and ranked search against brute force, on odd rows, and in parts and on disk."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftline.llm import phrases, search, suffixes

DOCS = "doc_id long, text string, lang string, part int, n int, score int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS)


def brute_phrases(rows, least):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out, frequent = [], {k for k, a in f.items() if a >= least}
    for lang, w in (k for k in frequent if len(k[1]) > 1):
        a = f[lang, w]
        if any(k[0] == lang and len(k[1]) > len(w) and any(k[1][i : i + len(w)] == w for i in range(len(k[1]))) and 100 * f[k] >= 80 * a for k in frequent):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    return out


@pytest.mark.parametrize("shard", [40, 10_000])
def test_phrases(spark, shard):
    rng = random.Random(shard)
    words = ["a", "B", "c", "é", "New", "York", "x\x1cy", " "]
    rows = [(i, "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", " "]) for w in rng.choices(words, [5, 4, 3, 2, 2, 2, 1, 1], k=rng.randint(0, 60))) + "new york city" * (i % 2), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(None, None, "en"), (3, "", None), (4, " ,. ", "fr"), *rows[:5]]
    found = phrases.sequences(frame(spark, rows), least=5, shard_words=shard)
    got = phrases.collocations(found).collect()
    want = brute_phrases(rows, 5)
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == sorted(want)
    for lang in {r.lang for r in got}:
        own = sorted((r for r in got if r.lang == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r.phrase for r in own] == [w[1] for w in sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))]
    assert phrases.mine(frame(spark, rows[:0])).collect() == []


def test_states_have_their_end_positions():
    ids = np.array([1, 2, 1, 2, 3, 0, 1, 2, 1, 0, 3], np.uint32)
    found = phrases.states(ids)
    text = ids.tolist()
    for j, (ends, counts, link) in enumerate(found, 1):
        want = Counter(tuple(text[i : i + j]) for i in range(len(text) - j + 1) if 0 not in text[i : i + j])
        got = {tuple(text[e - j + 1 : e + 1]): n for e, n in zip(ends.tolist(), counts.tolist(), strict=True)}
        assert got == want
        if j > 1:
            above = found[j - 2][0].tolist()
            assert all(text[e - j + 2 : e + 1] == text[above[k] - j + 2 : above[k] + 1] for e, k in zip(ends.tolist(), link.tolist(), strict=True))


def brute_bytes(rows, length):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], math.inf), math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (math.inf if doc is None else doc):
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "most"), [(1 << 15, 64 << 20), (3, 100)])
def test_suffixes(spark, hot, most):
    rng = random.Random(hot)
    make = lambda n: "".join(rng.choices("ab é\n\0", [5, 5, 3, 1, 1, 1], k=n))
    shared = [make(40) for _ in range(4)]
    rows = [(rng.randint(0, 30), "".join(rng.choice([make(rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))) for _ in range(60)]
    rows += [(None, None), (7, ""), (None, shared[0] * 2), (90, "a" * 500), (91, "a" * 300), (5, "x" * 40), *rows[:4], (200, make(5000) + shared[1])]
    got = suffixes.dedup(frame(spark, [(d, t, "en") for d, t in rows]), 16, 6, hot, most, 2000, 1500)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()), key=repr) == brute_bytes(rows, 16)
    assert suffixes.dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_induced_order(most):
    """Suffixes come in order to the depth asked for, whatever the alphabet, and share what the sorter says; queues in memory or on disk."""
    rng = random.Random(most)
    for _ in range(150):
        alphabet = rng.choice([b"\x02", b"\x02\x03", b"\x02\x03\x04\x05\x06", bytes(range(1, 200))])
        t = b"".join(bytes(rng.choices(alphabet, k=rng.randint(1, 60))) + b"\0" for _ in range(rng.randint(1, 5))) * rng.choice([1, 2])
        depth = rng.choice([5, 20, 50])
        at, shared = suffixes.Sorter(np.frombuffer(t, np.uint8), depth, most).sorted()
        key = lambda i, t=t, depth=depth: t[i : t.index(0, i) + 1][:depth]
        found = [(key(i), n) for i, n in zip(at.tolist(), shared.tolist(), strict=True) if t[i]]
        assert sorted(i for i in at.tolist() if t[i]) == [i for i in range(len(t)) if t[i]]
        assert [k for k, _ in found] == sorted(k for k, _ in found)
        for (a, _), (b, n) in zip(found, found[1:], strict=False):
            if a != b or a[-1]:
                assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in own:
            m = 10 + 90 * c.total() * n_docs // max(1, total)
            scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t]), d))
        scored = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, r, d, s) for r, (s, d) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block"), [(50, 100), (1 << 20, 8 << 20)])
def test_search(spark, monkeypatch, shard, block):
    rng = random.Random(shard)
    vocabulary = ["the", "The", "straße", "É", "x1", "42", "zeta", "rho"] + [f"w{i}" for i in range(60)]
    make = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=n))
    rows = [(rng.randint(0, 99), make(rng.randint(0, 40))) for _ in range(120)]
    rows += [(None, rows[0][1]), (1000, rows[0][1]), (3, None), (4, ""), (5, "!? --"), *rows[:6], (2000, make(4000)), (2001, "zeta")]
    items = [(i, make(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (7, "rho zeta"), (None, "the w1 w2"), (0, make(3))]
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    got = search.ranked(search.index(frame(spark, [(d, t, "en") for d, t in rows]), shard), table).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute_search(rows, items, 10)
    assert search.ranked(search.index(frame(spark, [])), table).collect() == []
    assert search.ranked(search.index(frame(spark, [(1, "a", "en")])), table.limit(0)).collect() == []
