"""What an assessor's answer is held to: citations, numbers, levels, scope; the spend ledger; strict times of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import level, rank

HHMM = r"^(?:[01]\d|2[0-3]):[0-5]\d$"


def is_hhmm(text: Column) -> Column:
    return text.rlike(HHMM)


def minute_of(text: Column) -> Column:
    """Minute of the day of a strict HH:MM, else null."""
    return F.when(is_hhmm(text), F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def first_object(text: Column) -> Column:
    """The first complete JSON object in an answer, as text, else null.

    What a fence holds is looked at first, then the whole text. From every opening brace a fold over the characters finds the brace
    that closes it, leaving out braces in strings, where a backslash takes the next character along; the first stretch that is
    JSON counts. What is JSON as a whole but no object, such as a list, has none, nor have null and blank texts.
    """
    def inside(x: Column) -> Column:
        chars = F.split(x, "")
        begins = F.filter(F.transform(chars, lambda c, i: F.when(c == "{", i)), lambda i: i.isNotNull())
        zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(False).alias("shut"))

        def step(s: Column, c: Column) -> Column:
            plain = ~s["quoted"]
            depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
            quoted = F.when(s["quoted"], (c != '"') | s["escaped"]).otherwise(c == '"')
            new = F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["n"] + 1).alias("n"), (plain & (c == "}") & (depth == 0)).alias("shut"))
            return F.when(s["shut"], s).otherwise(new)

        def closed(i: Column) -> Column:
            end = F.aggregate(F.slice(chars, i + 1, F.size(chars)), zero, step)
            return F.when(end["shut"], F.array_join(F.slice(chars, i + 1, end["n"]), ""))

        found = F.get(F.filter(F.transform(begins, closed), lambda o: o.isNotNull() & F.try_parse_json(o).isNotNull()), F.lit(0))
        whole = F.trim(x).rlike(r"(?s)^(\[.*\]|\".*\")$") & F.try_parse_json(x).isNotNull()
        return F.when(~whole, found)

    fenced = F.nullif(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(inside(fenced), inside(text))


def cited(text: Column) -> Column:
    """Identifiers (a capital with a number) in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Z]\d+\b"), F.lit(0))


def not_citable(cited_: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(cited_, allowed)))


def drift(text: Column, known: Column) -> Column:
    """Numbers in prose that no known one explains within the larger of 0.5 and 5 %.

    Identifiers, clock offsets such as t-30, and whole numbers below 4 are no claims.
    """
    bare = F.regexp_replace(text, r"\bt-\d+|\b[A-Z]+\d+", "")
    said = F.transform(F.regexp_extract_all(bare, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    near = lambda x: F.exists(known, lambda k: F.abs(x - k) <= F.greatest(F.lit(0.5), 0.05 * F.abs(k)))
    return F.filter(said, lambda x: ~((x < 4) & (x == F.floor(x))) & ~near(x))


def admissible(values: Column) -> Column:
    """Each number with its other units (km, minutes, km/h), rounded to 2, 1 and 0 places."""
    forms = F.flatten(F.transform(values, lambda x: F.array(x, x / 1000, x / 60, x * 3.6)))
    return F.array_distinct(F.flatten(F.transform(forms, lambda x: F.array(F.round(x, 2), F.round(x, 1), F.round(x, 0)))))


def floor_level(baseline: Column, agent: Column, rationale: Column) -> tuple[Column, Column]:
    """The level is never below the baseline; an agent that would go lower leaves its dissent."""
    a, b = F.coalesce(rank(agent), F.lit(0)), rank(baseline)
    return level(F.greatest(a, b)), F.when(a < b, rationale)


def escaped(text: Column) -> Column:
    """Untrusted text that can't close the block it stands in."""
    return F.replace(F.replace(text, F.lit("<<<"), F.lit("< < <")), F.lit(">>>"), F.lit("> > >"))


def out_of_scope(cited_zones: Column, own_zones: Column) -> Column:
    return F.array_sort(F.array_except(cited_zones, own_zones))


def confidence(score: Column, p0: Column, p1: Column, slack: float = 0.01) -> Column:
    """An assessor's score where its answer is sound: all from 0 to 1, two probabilities that add up to 1, the second the score.

    Null for any other answer; then the rules stand alone. The level never changes by it.
    """
    share = lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)
    return F.when(share(score) & share(p0) & share(p1) & (F.abs(p0 + p1 - 1) <= slack) & (F.abs(p1 - score) <= slack), score)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1")


def merge_alerts(alerts: DataFrame, answers: DataFrame) -> DataFrame:
    """Alerts with an agent's answers: the higher level, the higher priority, all evidence; a raise on a clear track makes an alert.

    alerts: track_id, level_rank, priority, evidence. answers: track_id, agent_rank, agent_priority, agent_evidence.
    """
    both = alerts.join(answers, "track_id", "full_outer")
    none = F.array().cast("array<string>")
    out = both.select(
        "track_id", F.greatest(F.coalesce("level_rank", F.lit(0)), F.coalesce("agent_rank", F.lit(0))).alias("level_rank"), F.greatest(F.coalesce("priority", F.lit(0.0)), F.coalesce("agent_priority", F.lit(0.0))).alias("priority"),
        F.array_sort(F.array_union(F.coalesce("evidence", none), F.coalesce("agent_evidence", none))).alias("evidence"), F.coalesce(F.col("agent_rank") < F.col("level_rank"), F.lit(False)).alias("dissent"),
    )
    return out.filter("level_rank > 0")


def ledger(spend: DataFrame, soft: float, hard: float) -> DataFrame:
    """With total, the running sum of cost in hundredths for each purpose, and whether it is over the soft and the hard stop.

    spend: e_key, at, purpose, cost.
    """
    w = Window.partitionBy("purpose").orderBy("at", "e_key")
    total = F.sum(F.round(F.col("cost") * 100).cast("long")).over(w) / 100
    return spend.withColumn("total", total).withColumn("soft", F.col("total") > soft).withColumn("hard", F.col("total") > hard)


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: images, answers, fallbacks, cache_hits, valid_rate, total_cost, median_ms (the upper one) of runs of a model.

    runs: valid, cached, cents, latency_ms. Runs are counted by latency first, so the median is looked up in a short table.
    """
    c = F.col
    per = runs.groupBy("latency_ms").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if("cached").alias("cached"), F.sum("cents").alias("cents"))
    upto = F.aggregate(F.array_sort(F.collect_list(F.struct("latency_ms", "n"))), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when((acc["at"].isNull()) & (acc["seen"] + x["n"] > F.floor(F.sum("n") / 2)), x["latency_ms"].cast("long")).otherwise(acc["at"]).alias("at")))["at"]
    whole = per.agg(F.sum("n").alias("images"), F.sum("valid").alias("answers"), F.sum("cached").alias("cache_hits"), F.sum("cents").alias("cents"), upto.alias("median_ms"))
    return whole.select("images", "answers", (c("images") - c("answers")).alias("fallbacks"), "cache_hits", F.round(c("answers") / c("images"), 4).alias("valid_rate"), (c("cents") / 100).alias("total_cost"), "median_ms")
