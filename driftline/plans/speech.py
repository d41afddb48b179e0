"""Queries on heard text and on runs of a model, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import guards, speech
from driftline.operators import reports as rep

from .registry import query
from .relations import table

_PHRASES = ", ".join(f"'{p}'" for p in speech.STOCK_PHRASES)
#: Turns of a conversation as a recogniser might write them down; first turns are stock phrases.
_HEARD = "CASE WHEN turn = 0 THEN concat('- ', upper(%s), '!! ') WHEN turn %% 3 = 1 THEN concat('  ,. ', replace(text, ' ', '  '), ' ...') WHEN turn %% 3 = 2 THEN concat(text, ' ,, ', text, ' !!') ELSE concat(chr(9), text, '??', chr(10)) END"
_SPARK_HEARD = _HEARD % f"element_at(array({_PHRASES}), cast(length(text) % {len(speech.STOCK_PHRASES)} + 1 AS int))"
_SQL_HEARD = _HEARD % f"([{_PHRASES}])[length(text) % {len(speech.STOCK_PHRASES)} + 1]"
_SQL_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({_SQL_HEARD}, ''), '[{speech.SPACE}]+', ' ', 'g'), '^[ .,;:!?\\-–—]+', ''), '\\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g'), '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g'), ' +([.,!?;:])', '\\1', 'g'), '[. ]+$', ''))"


def _folded(x: str) -> str:
    return f"trim(lower(translate({x}, '{rep.FOLD_FROM}', '{rep.FOLD_TO}')), ' .,!?')"


def heard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("heard", F.expr(_SPARK_HEARD))


@query(f"SELECT conv_id, turn, {_SQL_CLEAN} AS clean FROM conversations")
def sp_clean(spark: SparkSession, sf: str) -> DataFrame:
    return heard(spark, sf).select("conv_id", "turn", speech.clean(F.col("heard")).alias("clean"))


@query(f"SELECT conv_id, turn, {_folded(_SQL_CLEAN)} IN ({', '.join(_folded(repr(p)) for p in speech.STOCK_PHRASES)}) AS invented FROM conversations")
def sp_halluc(spark: SparkSession, sf: str) -> DataFrame:
    return heard(spark, sf).select("conv_id", "turn", speech.invented(F.col("heard")).alias("invented"))


@query("""SELECT count(*) AS images, count(*) FILTER (WHERE o_orderstatus <> 'P') AS answers, count(*) FILTER (WHERE o_orderstatus = 'P') AS fallbacks, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS cache_hits, round(count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*), 4) AS valid_rate, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e2 AS total_cost, (SELECT o_custkey * 7 % 997 FROM orders ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)) AS median_ms FROM orders""")
def rp_assess_all(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are runs of a model."""
    c = F.col
    runs = table(spark, sf, "orders").select((c("o_orderstatus") != "P").alias("valid"), (c("o_orderkey") % 3 == 0).alias("cached"), F.round(c("o_totalprice") * 100).cast("long").alias("cents"), (c("o_custkey") * 7 % 997).alias("latency_ms"))
    return guards.run_summary(runs)


_SPOKEN = ("on", "üç", "elliye", "yüz", "bin", "birinci", "Sıfır", "yirmi,", "dokuza", "kare", "yedi", "iki!")
_WORDS = ", ".join(f"'{w}'" for w in _SPOKEN)
_SAID = "concat_ws(' ', CASE turn %% 3 WHEN 0 THEN 'saat' WHEN 1 THEN 'hız' ELSE 'Saati' END, %s, text)"


def _picks(element: str) -> str:
    return ", ".join(element.format(f"CAST((length(text) * {i + 3} + conv_id * {2 * i + 1} + turn) % {len(_SPOKEN)} + 1 AS INT)") for i in range(4))


_SQL_SAID = _SAID % _picks(f"([{_WORDS}])[{{}}]")
_SUM = "list_reduce({0}, lambda a, v: CASE WHEN v = 1000 THEN (a // 1000000000 + CASE WHEN a % 1000000000 = 0 THEN 1 ELSE a % 1000000000 END * 1000) * 1000000000 WHEN v = 100 THEN a - a % 1000000000 + CASE WHEN a % 1000000000 = 0 THEN 1 ELSE a % 1000000000 END * 100 ELSE a + v END, 0::BIGINT)"


def _said(values: str) -> str:
    s = _SUM.format(values)
    return f"({s} // 1000000000 + {s} % 1000000000)"


_VALUES = ", ".join(f"('{w}', {v}::BIGINT)" for w, v in speech.VALUES.items())
_PATTERN = f"^({'|'.join(sorted(speech.VALUES, key=len, reverse=True))})({'|'.join(speech.ENDINGS)})?$"
_CUES = ", ".join(f"'{w}'" for w in speech.CLOCK)


@query(f"""WITH vals(stem, value) AS (VALUES {_VALUES}),
t AS (SELECT conv_id, turn, unnest(string_split(s, ' ')) AS token, unnest(generate_series(1, len(string_split(s, ' ')))) AS pos FROM (SELECT conv_id, turn, {_SQL_SAID} AS s FROM conversations)),
b AS (SELECT *, trim(lower(translate(token, '{rep.FOLD_FROM}', '{rep.FOLD_TO}')), '.,!?:;''’"') AS bare FROM t),
v AS (SELECT b.*, value, regexp_extract(bare, '{_PATTERN}', 2) AS ending FROM b LEFT JOIN vals ON stem = regexp_extract(bare, '{_PATTERN}', 1)),
m AS (SELECT *, coalesce(value IS NULL OR lag(value) OVER w IS NULL, true) AS new, coalesce(lag(bare) OVER w IN ({_CUES}), false) AS cue FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM m),
x AS (SELECT conv_id, turn, run, arg_min(cue, pos) AS cue, list(value ORDER BY pos) FILTER (WHERE value IS NOT NULL) AS vs, string_agg(token, ' ' ORDER BY pos) AS spoken, arg_max(ending, pos) AS ending, regexp_extract(arg_max(token, pos), '([.,!?:;]*)$', 1) AS tail FROM g GROUP BY ALL),
s AS (SELECT *, CASE WHEN cue AND len(vs) > 1 THEN list_max(list_filter(generate_series(1, len(vs) - 1), lambda k: {_said('vs[1:k]')} <= 23 AND {_said('vs[k + 1:]')} <= 59)) END AS k FROM x),
r AS (SELECT *, CASE WHEN vs IS NULL THEN spoken ELSE concat(CASE WHEN k IS NOT NULL THEN lpad({_said('vs[1:k]')}::VARCHAR, 2, '0') || ':' || lpad({_said('vs[k + 1:]')}::VARCHAR, 2, '0') WHEN cue AND {_said('vs')} <= 23 THEN lpad({_said('vs')}::VARCHAR, 2, '0') || ':00' WHEN len(vs) > 1 AND list_max(vs) < 10 THEN array_to_string(vs, '') ELSE {_said('vs')}::VARCHAR END, CASE WHEN ending <> '' THEN '''' || ending ELSE '' END, tail) END AS shown FROM s)
SELECT conv_id, turn, string_agg(shown, ' ' ORDER BY run) AS rewritten, count(*) FILTER (WHERE vs IS NOT NULL) AS changes FROM r GROUP BY conv_id, turn""")
def sp_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations begin with spoken numbers."""
    said = F.expr(_SAID % _picks(f"element_at(array({_WORDS}), {{}})"))
    found = speech.numbers(table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), said.alias("text")))
    return found.select("id.conv_id", "id.turn", "rewritten", F.size("changes").cast("long").alias("changes"))


@query("""WITH RECURSIVE b AS MATERIALIZED (SELECT user_id AS session_id, event_id AS seq, value / 4e3 AS rms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(session_id, i, seq, rms, phase, elapsed, held, spoken, silent, loud, noise, n, began, ended) AS (
  SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0e0, 'calibrating', 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0, false, NULL::VARCHAR FROM b
  UNION ALL SELECT session_id, i, seq, rms, CASE WHEN phase = 'done' THEN 'done' WHEN phase = 'calibrating' THEN CASE WHEN elapsed + 160 >= 300 THEN 'waiting' ELSE phase END WHEN phase = 'waiting' THEN CASE WHEN hot AND loud + 160 >= 150 THEN 'speaking' ELSE phase END
    WHEN (held + 160) / 1000 >= 15 THEN 'done' WHEN warm THEN 'speaking' WHEN silent + 160 >= 500 THEN 'done' ELSE 'trailing' END,
    CASE WHEN phase = 'calibrating' THEN elapsed + 160 ELSE elapsed END, CASE WHEN phase = 'waiting' AND hot AND loud + 160 >= 150 THEN loud + 160 WHEN talking THEN held + 160 ELSE held END,
    CASE WHEN phase = 'waiting' AND hot AND loud + 160 >= 150 THEN loud + 160 WHEN talking AND (held + 160) / 1000 < 15 AND warm THEN spoken + 160 ELSE spoken END,
    CASE WHEN phase = 'waiting' AND hot AND loud + 160 >= 150 THEN 0 WHEN talking AND (held + 160) / 1000 < 15 THEN CASE WHEN warm THEN 0 ELSE silent + 160 END ELSE silent END,
    CASE WHEN phase = 'waiting' THEN CASE WHEN hot THEN loud + 160 ELSE 0 END ELSE loud END,
    CASE WHEN phase = 'calibrating' THEN noise + (rms - noise) / (n + 1) WHEN phase = 'waiting' AND NOT hot THEN noise * 0.99e0 + rms * 0.01e0 ELSE noise END, CASE WHEN phase = 'calibrating' THEN n + 1 ELSE n END,
    phase = 'waiting' AND hot AND loud + 160 >= 150, CASE WHEN talking AND (held + 160) / 1000 >= 15 THEN 'max-duration' WHEN talking AND NOT warm AND silent + 160 >= 500 THEN 'silence' END
  FROM (SELECT f.session_id, b.i, b.seq, b.rms, phase, elapsed, held, spoken, silent, loud, noise, n, b.rms > greatest(noise, 0.004e0) * 3.5e0 AS hot, b.rms > greatest(noise, 0.004e0) * 2 AS warm, phase IN ('speaking', 'trailing') AS talking FROM f JOIN b ON b.session_id = f.session_id AND b.i = f.i + 1))
SELECT session_id, min(seq) FILTER (WHERE began) AS begin_seq, min(seq) FILTER (WHERE ended IS NOT NULL) AS end_seq, min(ended) AS ended, max(held) / 1000 AS held_s, bool_or(spoken / 1000 >= 0.25e0) AS sent FROM f WHERE i > 0 GROUP BY session_id""")
def sp_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events are blocks of sound of 160 ms."""
    blocks = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("value") / 4000).alias("rms"), F.lit(160.0).alias("ms"))
    return speech.utterances(speech.endpoints(blocks))
