"""The text operators against SQL where SQL can express them, else against brute force, and on odd rows."""

import functools
import hashlib
import re
import zlib
from array import array
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import decontaminate, jaccard, lines, packing, quality, queries, repetition, sharding, substrings, token_files, urls

SMALL = str(compare.DATA / "sf0.001")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert compare.difference(spark, duck, "sf0.001", queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_spaces_that_tokenizers_see(texts):
    """The byte encoder finds a space before any white space of Unicode without decoding, cuts arrays as to_pylist does, and keeps no second cache."""
    from driftline.llm import tokens

    for c in map(chr, [*range(0x3100), 0xFEFF, 0x1F600]):
        assert bool(tokens.ByteEncoder.SPACES.search(f"a {c}b".encode())) == c.isspace(), hex(ord(c))
    assert tokens.ByteEncoder.SPACES.search(b"a ") and not tokens.ByteEncoder.SPACES.search(b"a b")
    values = pa.array([b"a", b"", b"bcd"], pa.binary())
    for v in (values, values.slice(1), values.slice(3), pa.array([], pa.binary())):
        assert tokens.cut(v) == v.to_pylist()
    rows = ["a  b", "x.,; y!", "\n\n a\n", "\u00e9t\u00e9 \u3000z", "", "tail ", "w\nw.\nw", *(t or "" for t in texts.values())]
    encoder = tokens.ByteEncoder(BYTES, most=50)
    for _ in range(2):
        assert [list(array("I", x)) for x in encoder.encode([t.encode() for t in rows])] == [ids(BYTES, t) for t in rows]


def test_packing(spark, texts):
    rows = queries.op1_pack(spark, SMALL).collect()
    seats, pieces = {}, {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for own in seats.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    tokenizer = Tokenizer.from_file(WORDS)
    for k, text in texts.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(want), 4096)) and sum(r.length for r in got) == len(want)
        assert [r.ids_crc32 for r in got] == [zlib.crc32(array("I", want[r.start : r.start + r.length]).tobytes()) for r in got]
    total = sum(r.length for r in rows)
    assert len(seats) <= 1.05 * total / 4096 + 1


def test_plan_places_each_length_once():
    rng = np.random.default_rng(0)
    lengths = Counter(np.minimum(4096, rng.lognormal(6, 1, 4000).astype(int) + 1).tolist())
    made = packing.plan(dict(lengths), 4096)
    placed = Counter()
    for group, n in made:
        assert sum(group) <= 4096
        for x in group:
            placed[x] += n
    assert placed == lengths


def test_plan_keeps_its_patterns(monkeypatch):
    """Most sequences that the fitted patterns fill stand in the plan as they were, and there are as few as the tokens need."""
    rng = np.random.default_rng(1)
    lengths = dict(Counter(np.minimum(4096, rng.lognormal(6, 1.2, 6000).astype(int) + 1).tolist()))
    before, tightened = [], packing.tightened
    monkeypatch.setattr(packing, "tightened", lambda made, size: before.append(list(made)) or tightened(made, size))
    made = packing.plan(lengths, 4096)
    full = lambda groups: Counter({tuple(sorted(g)): c for g, c in groups if sum(g) == 4096 and len(g) > 1})
    assert (full(before[0]) & full(made)).total() >= 0.6 * full(before[0]).total() > 0
    assert sum(c for _, c in made) == -(-sum(n * c for n, c in lengths.items()) // 4096)


def test_token_files(spark, texts):
    rows = sorted(queries.op7_token_files(spark, SMALL).collect(), key=lambda r: r.doc_id)
    at, tokenizer = 0, Tokenizer.from_file(BYTES)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        want = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(array("I", want).tobytes()))
        at += len(want)


ODD_TEXTS = ["", " ", "\n\n a", "a  b", "tab\there.", "x y", "It's, don't! a.. b., c", "İstanbul É́", "<|endoftext|> A <|ENDOFTEXT|>", "a\x02b c", "a\x1cb, c", " lead", "trail ", "é è.", "1234 56.7,"]


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_ids_of_odd_texts(kind):
    from driftline.llm.tokens import ByteEncoder, WordEncoder

    path = WORDS if kind == "words" else BYTES
    encoder = (WordEncoder if kind == "words" else ByteEncoder)(path)
    for _ in range(2):  # the second time from the memo
        assert encoder.encode([t.encode() for t in ODD_TEXTS]) == [array("I", ids(path, t)).tobytes() for t in ODD_TEXTS]


def test_ids_of_many_odd_texts():
    """Newlines, marks and odd spaces in any order, learnt together."""
    import random

    from driftline.llm.tokens import ByteEncoder

    random.seed(1)
    parts = ["a", "Bc", "é", "1", ".", ",", "'s", "\n", "\n", " ", "\u3000", "\t", "\u2003", "\u00a0", "!?", "<|", "\x1c"]
    made = ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(4000)]
    encoder = ByteEncoder(BYTES)
    assert [encoder.encode([t.encode()])[0] for t in made[:500]] + encoder.encode([t.encode() for t in made[500:]]) == encoder.ids(made)


def test_token_files_of_repeated_ids(spark, tmp_path):
    """start and ids follow the files' order also where ids repeat; files have delta and dictionary pages, page indexes, and prune."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(1, "a b c " * k) for k in (30, 1, 4)] * 3 + [(None, None)] * 5 + [(k, f"text {k}") for k in range(2, 3000)], "doc_id long, text string")
    path = f"{tmp_path}/ids"
    token_files.write(docs, path, BYTES)
    files = token_files.read(spark, path)
    held = files.orderBy("shard", "row").collect()
    want, at = Counter(), 0
    for r in held:
        want[r.doc_id, at, r.n_tokens, zlib.crc32(array("I", r.ids).tobytes())] += 1
        at += r.n_tokens
    assert Counter(tuple(r) for r in token_files.digest(files).collect()) == want
    assert [r.doc_id for r in held] == sorted((r.doc_id for r in held), key=lambda x: (x is not None, x or 0))
    several = [f for f in map(pq.ParquetFile, map(str, tmp_path.glob("ids/*.parquet"))) if f.metadata.num_rows > 100]
    for f in several:
        cols = {f.metadata.row_group(0).column(i).path_in_schema.split(".")[0]: f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns)}
        assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and "RLE_DICTIONARY" in cols["ids"].encodings
        assert cols["doc_id"].has_offset_index and cols["doc_id"].has_column_index and cols["doc_id"].statistics.has_min_max
    assert several and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in files.filter("doc_id = 77")._jdf.queryExecution().toString()
    assert files.filter("doc_id = 77").count() == 1


def test_plan_needs_as_few_sequences_as_the_tokens():
    rng = np.random.default_rng(2)
    lengths = Counter(np.minimum(4096, rng.lognormal(6, 1, 6000).astype(int) + 1).tolist())
    assert sum(n for _, n in packing.plan(dict(lengths), 4096)) == -(-sum(k * n for k, n in lengths.items()) // 4096)


def test_repetition(spark, texts):
    for r in queries.op6_repetition(spark, SMALL).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + j for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for j in range(8)}
        held = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(inside))
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_quality_on_the_held_out_fold(spark):
    d = str(compare.DATA / "sf0.01")
    got = queries.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_shards(spark, texts):
    rows = queries.op10_shards(spark, SMALL).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    sizes, slots = Counter(), {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len((t or "").encode()) + 1 for t in texts.values())


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(30))
    edited = item.replace("word7 ", "other ").replace("word20 ", "")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"x y {edited} z"), (3, "nothing of the kind " * 30), (4, None), (5, "")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, item), (8, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, tests).collect()}
    assert got.keys() == {(1, 9), (2, 9)} and got[1, 9] == 1 and got[2, 9] > 0.8


@pytest.mark.parametrize("every", [5, 4])
@pytest.mark.parametrize("copies", [1, 400])
def test_edited_leaks_however_many(spark, every, copies):
    """Every fifth or fourth word replaced, alone or in many copies beside one that is whole: what the edits leave is then commonest."""
    item = [f"word{i}" for i in range(40)]
    edited = " ".join("other" if i % every == every - 1 else w for i, w in enumerate(item))
    rows = [(i, f"a{i} b {edited} c") for i in range(copies)] + [(1000, " ".join(["x", *item, "y"])), (1001, "nothing of the kind " * 30)]
    tests = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for docs in (rows, rows[:copies]):
        got = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), tests).collect()}
        assert got == {r[0] for r in docs} - {1001}


def test_leaks_by_brute_force(monkeypatch):
    """Every passage that the alignment of whole texts finds, once; whether hits are taken in parts or not, whatever pairs are common."""
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, n))) for k, n in enumerate((8, 12, 25, 40, 40, 60))]
    made = decontaminate.Items(items)
    made.rare(rng.integers(0, 5, len(made.every)))
    seen = 0
    for most in (decontaminate.MOST_HITS, 4):
        monkeypatch.setattr(decontaminate, "MOST_HITS", most)
        for share in (0, 0.1, 0.2, 0.25, 0.3):
            for k, text in items:
                words = [x for w in text.split() for x in ([w] if rng.random() >= share else rng.choice(["gone", "", f"{w} new more"]).split())]
                doc = " ".join([f"w{x}" for x in rng.integers(0, 60, 50)] + words + ["gap"] * 90 + [f"w{x}" for x in rng.integers(0, 60, 50)] + words).split()
                numbers = np.array([made.known.get(w.encode(), -1) for w in doc], np.int64)
                got = [x for x in decontaminate.passages(numbers, made) if x[0] == k]
                own = dict(made.words)[k]
                score = decontaminate.align(own, numbers)[0] / (2 * len(own))
                if score >= decontaminate.LEAST:
                    seen += 1
                    alone = decontaminate.align(own, np.array([made.known.get(w.encode(), -1) for w in words], np.int64))[0] / (2 * len(own))
                    assert len(got) >= 1 + (alone >= decontaminate.LEAST) and max(x[1] for x in got) == score
    assert seen > 30


def test_leaks_with_words_put_in(spark):
    """200 items with a foreign word after every second one are all found: recall is that of aligning all pairs; exact copies in a vast vocabulary too."""
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 3000, 40))) for k in range(200)]
    docs = [(k, " ".join(["lead"] * 20 + [x for i, w in enumerate(t.split()) for x in ([w, f"foreign{i}"] if i % 2 else [w])] + ["tail"] * 20)) for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got.keys() >= {(k, k) for k in range(200)} and all(got[k, k] >= 0.75 for k in range(200))
    many = decontaminate.Items([(k, " ".join(f"u{k}x{i}" for i in range(22_000))) for k in range(100)] + [(100, items[0][1])])
    assert len(many.known) > 2_097_152
    numbers = np.array([many.known[w.encode()] for w in items[0][1].split()], np.int64)
    assert [x[:2] for x in decontaminate.passages(numbers, many)] == [(100, 1.0)]


def test_short_items_word_for_word(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "one two three"), (3, None), (4, " "), (5, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One, y"), (2, "one two, three."), (3, "one three two"), (4, "a b c d e f g"), (5, "a b c x d e f g"), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 5)}


def test_aliases_of_blocked_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.com/en/1", ""), (2, "http://b.net/x", link.format("http://a.com/en/1")), (3, "http://c.net/y", '<meta http-equiv="refresh" content="0; url=http://b.net/x">'), (4, "http://d.net/z", ""), (5, None, None), (6, "no url", link.format("http://a.com/en/1")), (7, "http://example.com/en/7", link.format("http://e.net/q")), (8, "http://e.net/q", link.format("http://a.com/en/2")), (9, "http://a.com/en/2", "")]
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == {1: ("block", "com/en/"), 2: ("block", None), 3: ("block", None), 4: ("allow", None), 5: ("allow", None), 6: ("allow", None), 7: ("allow", "example.com/en/7"), 8: ("allow", None), 9: ("block", "com/en/")}


def test_links_are_resolved(spark):
    """Dot segments, urls without a path, lists of rel, comments, bases, links of no page; odd columns and no pages at all."""
    link = '<LINK data-rel="x" rel="alternate canonical" href="{}">'
    rows = [
        (1, "http://a.com/en/q", ""), (2, "http://a.com/en/b/p", link.format("../q")), (3, "http://b.net/x/y/p", link.format("./t")), (4, "http://b.net/x/y/t", link.format("http://a.com/de/../en/q")),
        (5, "http://c.net", link.format("q")), (6, "http://c.net/q", link.format("http://a.com/en/q")), (7, "http://d.net/p", f"<!-- {link.format('http://a.com/en/q')} -->"), (8, "http://e.net/x/p", '<base href="http://a.com/en/b/">' + link.format("../q")),
        (9, "http://f.net/p", link.format("mailto:a@a.com/en/q")), (10, "http://g.net/p", "<link rel=canonical href='//a.com/en/q'>"), (11, "http://h.net/p", '<meta content="0;URL=\'http://a.com/en/q\'" http-equiv=refresh>'), (12, "http://c.net/", ""), (13, "http://i.net/p", '<link rel="canonicals" href="http://a.com/en/q">'),
        (14, "http://j.net/a/../p", ""), (15, "http://k.net/p", link.format("http://j.net/p")), (16, "http://j.net/p", link.format("http://a.com/en/q")),
    ]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, number int, alias string")
    got = {r.page_id: r.verdict for r in urls.judge(frame, queries.RULES).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 14, 15, 16} and len(got) == 16
    assert urls.judge(frame.limit(0), queries.RULES).collect() == []


def test_pages_of_one_path_are_told_apart_by_query(spark):
    link, blocked = '<link rel="canonical" href="{}">', "http://a.com/en/1"
    rows = [
        (1, "http://b.net/i?id=1", link.format(blocked)), (2, "http://b.net/i?id=2", ""), (3, "http://b.net/i", ""), (4, "http://b.net/i?id=1#top", ""),
        (5, "http://c.net/d/i?a=5&b=1", link.format("?a=6&amp;b=1")), (6, "http://c.net/d/i?a=6&b=1", link.format(blocked)), (7, "http://c.net/d/i?a=7&b=1", link.format("#part")), (8, "http://c.net/d/", ""),
        (9, "http://e.net/i?id=1", link.format("http://example.com/en/7?x=1")), (10, "http://e.net/i?id=2", link.format(blocked)),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 4, 5, 6, 10} and len(got) == 10


def test_short_sketches_rule_out_no_link():
    rng = np.random.default_rng(5)
    for size in (1, 20, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.union1d(a[size // 10 :], rng.integers(0, 1 << 63, size // 15).astype(np.uint64))
        x, y = (np.frombuffer(jaccard.parities(s, 256), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_no_link_is_lost():
    """Sets that link meet under a key, whatever the boundary between light and heavy."""
    rng = np.random.default_rng(1)
    often = rng.integers(0, 50, 1 << 10).astype(np.uint32)
    for percent in (90, 80):
        for n in (*range(1, 40), 70, 150, 400):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            most = jaccard.far(len(a), len(a), percent)
            for gone in range(min(most, len(a) - 1) + 1):
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 62, most - gone).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    for boundary in (0, jaccard.light_limit(percent)):
                        for counts in (None, often):
                            keys = jaccard.Lists(percent, boundary, counts)
                            assert len(np.intersect1d(keys.keys(a), keys.keys(b)))


def test_rare_elements_come_first():
    s = np.arange(1, 101, dtype=np.uint64) << np.uint64(3)
    counts = np.zeros(1 << 16, np.uint32)
    at = (jaccard.mix(s) & np.uint64(len(counts) - 1)).astype(np.int64)
    counts[at] = 100 + np.arange(100)
    lists = jaccard.Lists(90, 0, counts)
    assert jaccard.prefix_length(100, 90) == 11
    assert set(lists.prefix(s).tolist()) == set(s[np.argsort(counts[at], kind="stable")][:11].tolist())


def test_boundary_follows_the_lists():
    """Short lists leave all sets heavy; where lists are long, subsets are enumerated."""
    short = {n: (100, 100.0) for n in range(1, jaccard.small_limit(90) + 1)}
    long = {n: (100, 1e7) for n in short}
    assert jaccard.boundary(short, 90) < jaccard.boundary(long, 90) == jaccard.light_limit(90)


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (4, "same text here"), (None, "no id at all"), (5, LONG), (6, LONG + " end"), (7, "one"), (8, "\n\n"), (9, "a line of ten words that is long enough to count\n" * 3)]


@functools.cache
def model(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(quality.training_rows(docs, labels))


KEPT = {"op1": lambda d: packing.pack(d, WORDS).filter("piece = 0"), "op2": substrings.dedup, "op4": lambda d: quality.score(d, model(d.sparkSession)), "op5": lines.report, "op6": repetition.judge, "op7": lambda d: token_files.round_trip(d, BYTES), "op9": jaccard.classes, "op10": sharding.split}


@pytest.mark.parametrize("name", KEPT)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame([(*x, 1, 2, "k") for x in ODD], "doc_id long, text string, node int, bucket int, `key` string")
    got = KEPT[name](docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in ODD)
    assert KEPT[name](docs.limit(0)).count() == 0


def test_odd_rows_of_the_others(spark):
    docs = spark.createDataFrame([(*x, 1, "k") for x in ODD], "doc_id long, text string, score int, key string")
    bench = spark.createDataFrame([(1, "w0x0 w1x0 w2x0 w3x0 w4x0 w5x0 w6x0 w7x0 w8x0 w9x0"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {5, 6}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0
    kept = {r.doc_id for r in jaccard.representatives(docs).collect()}
    assert kept >= {1, 2, 5, 7, 8, 9} and not kept & {4, 6}
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()}[9] == "a line of ten words that is long enough to count\n"


def test_unlinked_documents_of_one_id_or_none_stay(spark, tmp_path):
    import corpus_pipeline as pipe

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (2, f"{a} end"), (None, f"{b} end"), (3, d), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in jaccard.representatives(docs).collect())
    near = {(None, b), (None, f"{b} end")} & kept.keys()
    assert len(near) == 1 and kept == Counter([*near, (2, f"{a} end"), (1, c), (1, d), (None, ""), (None, None)])
    spark.createDataFrame([(7, a), (8, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = Counter(tuple(r) for r in pipe.drop_leaks(spark, docs, str(tmp_path)).collect())
    assert left == Counter(rows) - Counter([(None, a), (2, f"{a} end"), (1, c)])


def test_repeats_by_hash(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d e"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.dedup(docs).collect()}
    assert got == {1: (60, hashlib.sha256(b"a b c").hexdigest()), 2: (60, hashlib.sha256(b"d e").hexdigest()), 3: (0, hashlib.sha256(b"short").hexdigest())}


CLASHING = ["removed", "_d", "_t", "_leaked", "_text", "_gone", "node", "size", "u"]


@pytest.mark.parametrize("number", range(5))
def test_odd_rows_of_a_stage(spark, number):
    """Nulls, repeated rows, a very long text and columns named like the helpers; what a stage does not reject comes out as it was."""
    import corpus_pipeline as pipe

    rows = [(*x, "en", "s", 99, *CLASHING) for x in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING))
    stage = pipe.STAGES[number][1]
    got = stage(spark, docs, SMALL)
    if number < 4:
        assert got.columns == docs.columns and stage(spark, docs.limit(0), SMALL).count() == 0
        found = Counter(tuple(r) for r in got.collect())
        changed = found - Counter(rows)
        assert not changed if number != 1 else {r[:2] + (r[4],) for r in changed} == {(9, "a line of ten words that is long enough to count\n", 49)}
        assert number == 0 or found[(1, None, *rows[0][2:])] == found[(2, "", *rows[0][2:])] == 1
    else:
        assert Counter(r.doc_id for r in got.filter("piece = 0").collect()) == Counter(x[0] for x in ODD)


def test_hinge_loss_by_plain_descent():
    """The solver reaches the least of its objective: plain descent on that objective gets to no lower value."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(120)]
    y = np.where([(5 in r) != (rng.random() < 0.1) for r in rows], 1, -1)
    ratio, weight, cost = rng.normal(0, 1, 30), np.ones(120), 1.0
    x = np.zeros((120, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 30] = 1  # the bias is a weight like others
    top = cost * len(rows) / 100 * weight
    value = lambda v: v @ v / 2 + (top * np.maximum(0, 1 - y * (x @ v))).sum()
    v, best = np.zeros(31), np.inf
    for step in range(1, 60_000):
        slack = y * (x @ v) < 1
        v -= (v - x.T @ (top * y * slack)) / (step + 50)
        best = min(best, value(v)) if step % 50 == 0 else best
    w, bias = quality.dual_descent(rows, y, ratio, weight, cost, epochs=300)
    assert value(np.append(w, bias)) <= best * 1.002


def test_ratios_by_counting(spark):
    """An indicator's log-count ratio follows how often either class has it."""
    rows = spark.createDataFrame([(i, "good words here" if i % 2 else "bad words there", i % 2) for i in range(60)], "doc_id long, text string, label int")
    made = quality.train(rows)
    at = lambda text: set(quality.indicators(text, quality.Features()).tolist())
    good, bad = at(b"good words here"), at(b"bad words there")
    assert all(made.ratio[k] > 0.5 for k in good - bad) and all(made.ratio[k] < -0.5 for k in bad - good) and all(abs(made.ratio[k]) < 1e-6 for k in good & bad)
    scores = {r.doc_id: r.score for r in quality.score(rows.drop("label"), made).collect()}
    assert all((s >= 0.5) == bool(k % 2) for k, s in scores.items())


def test_pipeline(spark, texts):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(pipe.STAGES[:-1]):
        docs = pipe.cut(stage(spark, docs, SMALL), f"test-{i}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert all(a >= b > 0 for a, b in zip(counts, counts[1:], strict=False))
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert pipe.run(spark, SMALL).select("doc_id").distinct().count() == counts[-1]


def plain_lines(texts):
    """Removed lines by comparing every line with every earlier one."""
    def alike(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    seen, out = [], {}
    for doc in sorted(texts):
        kept = []
        for raw in (texts[doc] or "").split("\n"):
            words = re.findall(r"[^ \t\r\x0B\f]+", raw)
            if not words or not any(alike(words, s) for s in seen):
                kept.append(raw)
            if words:
                seen.append(words)
        out[doc] = "\n".join(kept)
    return out


def test_stages_by_brute_force(spark):
    """Lines, near duplicates and leaks of a fixture with planted cases, each on what the stage before kept."""
    import corpus_pipeline as pipe

    rng = np.random.default_rng(9)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    some = [line(14) for _ in range(12)]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).collect()]
    texts = {}
    for k in range(60):
        own = [line(15) for _ in range(6)]
        if k % 4 == 0:
            words = some[k % 12].split()
            words[3] = f"edit{k}"
            own.insert(2, " ".join(words))
        texts[k] = "\n".join(own)
        if k % 10 == 7:
            texts[k] += "\n" + items[k % 3]
        if k % 6 == 5:
            words = texts[k - 3].replace("\n", " ").split()
            words[10] = "other"
            texts[k] = "\n".join(" ".join(words[i : i + 13]) for i in range(0, len(words), 13))
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    after = {r.doc_id: r.text for r in pipe.drop_lines(spark, docs, SMALL).collect()}
    plain = plain_lines(texts)
    assert after == {k: t if t != texts[k] else texts[k] for k, t in plain.items() if t.strip()} and any(after[k] != texts[k] for k in after)

    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in after.items() if (w := t.lower().split())}
    least = dict.fromkeys(after)
    for k in after:
        least[k] = k
    for a in sorted(sets):  # links, then the least of what they reach
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    kept = pipe.drop_near_copies(spark, spark.createDataFrame(list(after.items()), docs.schema), SMALL)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left.keys() == set(least.values()) < after.keys()

    held = {r.doc_id for r in pipe.drop_leaks(spark, kept, SMALL).collect()}
    assert held == {k for k in left if not any(" ".join(i.split()) in " ".join(left[k].split()) for i in items)} and held < left.keys()
