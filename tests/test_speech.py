"""Spoken numbers against a plain reading of the rules, and ends of utterances in batch and stream."""

import itertools
import random

import pytest

from driftline.operators import speech
from driftline.streaming import endpoints

SAID = [
    ("saati on üç elliye al", "saati 13:50'ye al"), ("hizi uc yuze al", "hizi 300'e al"), ("sifir sifir bes", "005"), ("sıfır yüz otuz iki'yi", "130 iki'yi"), ("uc kare ileri git", "3 kare ileri git"),
    ("bin dokuz yuz", "1900"), ("iki yuz otuz", "230"), ("saat on", "saat 10:00"), ("saat yetmis", "saat 70"), ("saat yirmi uc elli dokuz!", "saat 23:59!"), ("sekiz yuz altmis numarali", "860 numarali"), ("bu arac neden kirmizi", "bu arac neden kirmizi"),
    ("Beşinci, altıncı", "56'nci"), ("", ""), ("a  iki  b", "a  2  b"), ("sıfır  bir", "0  1"), ("saat bes bes", "saat 05:05"),
]


def test_spoken_numbers(spark):
    got = {r.id: r for r in speech.numbers(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)] + [(99, None)], "id int, text string")).collect()}
    for i, (text, want) in enumerate(SAID):
        assert got[i].rewritten == want, text
    assert got[12].changes == ["Beşinci, altıncı -> 56'nci"]
    assert got[99].rewritten == "" and got[4].changes == ["uc -> 3"] and got[11].changes == []


def value(words):
    total = current = 0
    for w in words:
        v = speech.VALUES[w]
        if v == 1000:
            total, current = total + (current or 1) * 1000, 0
        else:
            current = (current or 1) * 100 if v == 100 else current + v
    return total + current


def test_numbers_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [*speech.VALUES] * 2 + ["saat", "kare", "ve"]
    texts = [rng.choices(vocabulary, k=rng.randint(0, 9)) for _ in range(400)]
    got = {r.id: r.rewritten for r in speech.numbers(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")).collect()}
    for i, words in enumerate(texts):
        want, cue = [], False
        for numeric, run in itertools.groupby(words, lambda w: w in speech.VALUES):
            run = list(run)
            if not numeric:
                want, cue = want + run, run[-1] == "saat"
                continue
            said = None
            if cue:
                said = next((f"{value(run[:k]):02d}:{value(run[k:]):02d}" for k in range(len(run) - 1, 0, -1) if value(run[:k]) <= 23 and value(run[k:]) <= 59), f"{value(run):02d}:00" if value(run) <= 23 else None)
            if said is None and len(run) > 1 and all(speech.VALUES[w] < 10 for w in run):
                said = "".join(str(speech.VALUES[w]) for w in run)
            want.append(said or str(value(run)))
        assert got[i] == " ".join(want), words


def sessions():
    quiet, loud, middle = 0.005, 0.05, 0.012
    return {
        1: [quiet] * 10 + [loud] * 10 + [quiet] * 20, 2: [quiet] * 60, 3: [quiet] * 10 + [loud] * 3 + [quiet] * 20, 4: [quiet] * 10 + [loud] * 600, 5: [quiet] * 10 + [loud] * 6 + [middle] * 10 + [quiet] * 20,
        6: [0.0] * 10 + [0.013] * 3 + [0.015] * 5 + [0.0] * 20, 7: [quiet] * 10 + [loud] * 8,
    }


def blocks(spark):
    return spark.createDataFrame([(s, i, rms, 32.0) for s, own in sessions().items() for i, rms in enumerate(own)], "session_id long, seq long, rms double, ms double")


def test_ends_of_utterances(spark):
    heard = speech.endpoints(blocks(spark))
    got = {r.session_id: r for r in speech.utterances(heard).collect()}
    assert (got[1].begin_seq, got[1].ended, got[1].sent) == (14, "silence", True) and got[1].end_seq == 20 + 15
    assert got[2].begin_seq is None and got[2].ended is None
    assert got[3].begin_seq is None
    assert got[4].ended == "max-duration" and got[4].held_s == pytest.approx(15, abs=0.04)
    assert got[5].ended == "silence" and got[5].end_seq == 26 + 15  # the trailing word, over the release level, holds on
    assert got[6].begin_seq is None or got[6].begin_seq > 12
    assert got[7].begin_seq == 14 and got[7].ended is None


def test_stream_of_blocks_is_the_batch(spark, tmp_path):
    rows = [tuple(r) for r in blocks(spark).collect()]
    schema = "session_id long, seq long, rms double, ms double"
    for lo, hi in ((0, 13), (13, 29), (29, 1000)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = endpoints.endpoints(stream).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    assert sorted(map(str, spark.table("heard").collect())) == sorted(map(str, speech.endpoints(blocks(spark)).collect()))
