"""Speech: where an utterance begins and ends, what a recogniser heard made plain, stock phrases that it invents, spoken numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import fold

#: Characters that count as white space, for use inside brackets.
SPACE = " \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Phrases that recognisers of Turkish give for silence.
STOCK_PHRASES = ("altyazı m.k.", "altyazı m k", "altyazi m.k.", "abone olmayı unutmayın", "altyazılar için teşekkürler", "izlediğiniz için teşekkürler", "teşekkürler", "müzik", "alt yazı", "sessizlik", "devam edecek")


def clean(text: Column) -> Column:
    """White space collapsed, no punctuation or dashes in front, none repeated or after a space, no full stops at the end. Null is empty."""
    steps = ((f"[{SPACE}]+", " "), (f"^[{SPACE}.,;:!?\\-–—]+", ""), ("([.,!?])\\1+", "$1"), (" +([.,!?;:])", "$1"), ("[. ]+$", ""))
    return F.trim(reduce(lambda x, step: F.regexp_replace(x, *map(F.lit, step)), steps, F.coalesce(text, F.lit(""))))


def invented(text: Column) -> Column:
    """Whether the text, whatever its case, accents and outer punctuation, is a stock phrase."""
    bare = lambda x: F.btrim(fold(x), F.lit(" .,!?"))
    return bare(clean(text)).isin(*(bare(F.lit(p)) for p in STOCK_PHRASES))

# Number words without accents, endings in the order in which they are tried, words that announce a time.
UNITS = ("sifir", "bir", "iki", "uc", "dort", "bes", "alti", "yedi", "sekiz", "dokuz")
TENS = ("on", "yirmi", "otuz", "kirk", "elli", "altmis", "yetmis", "seksen", "doksan")
SCALES = (("yuz", 100), ("bin", 1000))
ENDINGS = ("inci", "uncu", "nci", "ncu", "den", "dan", "ten", "tan", "nin", "nun", "ler", "lar", "de", "da", "te", "ta", "ye", "ya", "yi", "yu", "in", "un", "e", "a", "i", "u")
CLOCK = ("saat", "saati", "saate", "saatte", "saatini", "zamani")
OUTER = ".,!?:;'’\""

VALUES = {w: i for i, w in enumerate(UNITS)} | {w: (i + 1) * 10 for i, w in enumerate(TENS)} | dict(SCALES)


def _number(values: str) -> str:
    """SQL for the quantity that an array of word values says: hundreds multiply what stands before them, thousands close it."""
    return f"aggregate({values}, named_struct('t', 0L, 'c', 0L), (s, v) -> named_struct('t', IF(v = 1000, s.t + IF(s.c = 0, 1L, s.c) * 1000L, s.t), 'c', CASE v WHEN 1000L THEN 0L WHEN 100L THEN IF(s.c = 0, 1L, s.c) * 100L ELSE s.c + v END), s -> s.t + s.c)"


def _two(number: str) -> str:
    return f"lpad(CAST({number} AS string), 2, '0')"


def numbers(heard: DataFrame) -> DataFrame:
    """heard (id, text) with rewritten and changes: runs of number words as digits, and what was rewritten, as "spoken -> digits".

    After a word for time a run is a clock, with the longest hour that leaves a minute, or a whole hour; two or more unit words
    alone are digits read out; everything else is a quantity. Words may have an ending; the last one's stays behind an apostrophe.
    Null is empty. Words are rows and runs their groups, so that long texts spread.
    """
    bare = F.btrim(fold(F.col("token")), F.lit(OUTER))
    words = heard.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "token")).withColumn("bare", bare)
    pattern = f"^({'|'.join(sorted(VALUES, key=len, reverse=True))})({'|'.join(ENDINGS)})?$"
    stem = F.regexp_extract("bare", pattern, 1)
    known = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    words = words.withColumn("value", F.when(stem != "", F.element_at(known, stem).cast("long"))).withColumn("ending", F.regexp_extract("bare", pattern, 2))
    w = Window.partitionBy("id").orderBy("pos")
    before = F.lag(F.col("value").isNotNull()).over(w)
    marked = words.withColumns({"new": F.coalesce(F.col("value").isNull() | ~before, F.lit(True)), "cue": F.coalesce(F.lag("bare").over(w).isin(*CLOCK), F.lit(False))})
    runs = marked.withColumn("run", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "value", "ending"))).alias("x"), F.max(F.struct((-F.col("pos")).alias("p"), "cue")).getField("cue").alias("cue"))
    each = each.selectExpr("id", "run", "cue", "transform(filter(x, a -> a.value IS NOT NULL), a -> a.value) AS v", "array_join(transform(x, a -> a.token), ' ') AS spoken", "element_at(x, -1).ending AS ending", "regexp_extract(element_at(x, -1).token, '([.,!?:;]*)$', 1) AS tail")
    cut_at = f"element_at(filter(reverse(sequence(1, size(v) - 1)), k -> {_number('slice(v, 1, k)')} <= 23 AND {_number('slice(v, k + 1, size(v))')} <= 59), 1)"
    each = each.withColumn("at", F.when(F.col("cue") & (F.size("v") > 1), F.expr(cut_at.replace("element_at(", "try_element_at(", 1))))
    clock = F.when(F.col("at").isNotNull(), F.expr(f"concat({_two(_number('slice(v, 1, at)'))}, ':', {_two(_number('slice(v, at + 1, size(v))'))})")).when(F.col("cue") & F.expr(f"{_number('v')} <= 23"), F.expr(f"concat({_two(_number('v'))}, ':00')"))
    digits = F.when((F.size("v") > 1) & F.expr("forall(v, a -> a < 10)"), F.expr("array_join(transform(v, a -> CAST(a AS string)), '')"))
    said = F.coalesce(clock, digits, F.expr(f"CAST({_number('v')} AS string)"))
    each = each.withColumn("shown", F.when(F.size("v") > 0, F.concat(said, F.when(F.col("ending") != "", F.concat(F.lit("'"), "ending")).otherwise(""), "tail")))
    every = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", F.coalesce("shown", "spoken").alias("text"), F.when(F.col("shown").isNotNull(), F.concat("spoken", F.lit(" -> "), "shown")).alias("change")))).alias("r"))
    return heard.join(every, "id").withColumns({"rewritten": F.expr("array_join(transform(r, x -> x.text), ' ')"), "changes": F.expr("array_compact(transform(r, x -> x.change))")}).drop("r")


@dataclass(frozen=True)
class Endpoint:
    """When an utterance begins and ends, in milliseconds and multiples of the room's noise."""

    silence_ms: float = 500.0
    onset_ms: float = 150.0
    most_s: float = 15.0
    least_s: float = 0.25
    calibration_ms: float = 300.0
    onset: float = 3.5
    release: float = 2.0
    floor: float = 0.004


#: phase, ms so far, held, spoken, silent and loud ms, noise, frames it was measured on
ENDPOINT_STATE = "phase string, elapsed double, held double, spoken double, silent double, loud double, noise double, measured long"
QUIET = ("calibrating", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
HEARD = "session_id long, seq long, phase string, started boolean, finished string, level double, held_s double, floor double, long_enough boolean"


def frame(state: tuple, rms: float, ms: float, c: Endpoint) -> tuple[tuple, tuple]:
    """The state after one block of sound, and (phase, started, finished, level, held_s, floor, long_enough).

    The room is measured first, and followed slowly while it is quiet; a loud block never counts as noise. Blocks after the end of an
    utterance change nothing."""
    phase, elapsed, held, spoken, silent, loud, noise, measured = state
    began, ended = False, None
    floor = max(noise, c.floor)
    if phase == "done":
        pass
    elif phase == "calibrating":
        elapsed += ms
        measured += 1
        noise += (rms - noise) / measured
        phase = "waiting" if elapsed >= c.calibration_ms else phase
    elif phase == "waiting" and rms > floor * c.onset:
        loud += ms
        if loud >= c.onset_ms:
            phase, began, spoken, held, silent = "speaking", True, loud, loud, 0.0
    elif phase == "waiting":
        noise, loud = noise * 0.99 + rms * 0.01, 0.0
    else:
        held += ms
        if held / 1000 >= c.most_s:
            phase, ended = "done", "max-duration"
        elif rms > floor * c.release:
            phase, spoken, silent = "speaking", spoken + ms, 0.0
        else:
            phase, silent = "trailing", silent + ms
            if silent >= c.silence_ms:
                phase, ended = "done", "silence"
    floor = max(noise, c.floor)
    level = math.sqrt(min(1.0, max(0.0, (rms - floor) / (floor * 8))))
    return (phase, elapsed, held, spoken, silent, loud, noise, measured), (phase, began, ended, level, held / 1000, floor, spoken / 1000 >= c.least_s)


def endpoints(blocks: DataFrame, config: Endpoint = Endpoint()) -> DataFrame:
    """HEARD of every block (session_id, seq, rms, ms): each session's blocks stream through one task in order, with a state of eight numbers."""
    sent = blocks.selectExpr("CAST(session_id AS long) AS session_id", "CAST(seq AS long) AS seq", "CAST(rms AS double) AS rms", "CAST(ms AS double) AS ms").repartition("session_id").sortWithinPartitions("session_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, QUIET
        for b in batches:
            out = []
            for s, seq, rms, ms in zip(*(b.column(c).to_pylist() for c in ("session_id", "seq", "rms", "ms")), strict=True):
                if s != session:
                    session, state = s, QUIET
                state, told = frame(state, rms, ms, config)
                out.append((s, seq, *told))
            if out:
                yield pa.RecordBatch.from_pydict({f.split()[0]: list(c) for f, c in zip(HEARD.split(", "), zip(*out, strict=True), strict=True)}, HEARD_ARROW)

    return sent.mapInArrow(run, HEARD)


HEARD_ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in HEARD.split(", ")])


def utterances(heard: DataFrame) -> DataFrame:
    """session_id, begin_seq, end_seq, ended (silence, max-duration, or null while open), held_s, sent: whether it was long enough."""
    return heard.groupBy("session_id").agg(
        F.min(F.when(F.col("started"), F.col("seq"))).alias("begin_seq"), F.min(F.when(F.col("finished").isNotNull(), F.col("seq"))).alias("end_seq"),
        F.min("finished").alias("ended"), F.max("held_s").alias("held_s"), F.bool_or("long_enough").alias("sent"),
    )
