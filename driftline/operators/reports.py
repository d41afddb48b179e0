"""Field reports: text to claims by ordered patterns, claims against what the frame and the tracks show, and the verdict."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config
from driftline.functions.geo import box_distance
from driftline.functions.stages import written

from .behaviour import as_of_join
from .matching import pairs

# The letters that are folded, the vocabulary and the patterns of the reports' language, in their order.
FOLD_FROM, FOLD_TO = "çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosucgiosuaiuaiu"
COORDINATES = r"(?i)(\d{1,2}\.\d+)\s*([NS])[\s,]+(\d{1,3}\.\d+)\s*([EW])"
COUNT_TYPE = r"(\d+)\s+(?:agir\s+)?(kamyonet|kamyon|minibus|otobus|otomobil|panelvan|van|arac)"
VEHICLES = (("kamyonet", "van"), ("panelvan", "van"), ("minibus", "van"), ("van", "van"), ("kamyon", "truck"), ("otobus", "bus"), ("otomobil", "car"), ("binek arac", "car"), ("agir arac", "heavy"), ("arac", "vehicle"))
KINDS = (
    ("degraded_coverage", r"telsiz\s+baglantisi.*kurulam"),
    ("identified_friendly", r"kimlik\s+teyidi\s+yapilmis|planli\s+ikmal|bize\s+bagli|dost\s+devriye|teyitlidir"),
    ("area_wide", r"tatbikat|dost\s+unsurlar|lojistik\s+konvoyu"),
    ("unverified", r"dogrulanmamis|dogrulanamad"),
    ("irrelevant", r"hava\s+(acik|kapali|bulutlu)|gorus\s+mesafesi|sis\b|yagis"),
    ("negative_claim", r"(hareket(i|liligi)?|arac)\s+yok|yalnizca\s+binek"),
    ("zone_status", r"trafik\s+akisi\s+normal|olagandisi\s+bir\s+durum\s+bildirmedi|kayda\s+deger\s+bir\s+hareketlilik\s+bulunmuyor|sakin"),
    ("density", r"(genellikle|olagan\s+trafik)\s+\d+\s+arac"),
)
USUAL_COUNT = r"(?:genellikle|olagan\s+trafik)\s+(\d+)\s+arac"
HEAVY = r"agir\s+(?:bir\s+)?arac|\(kamyon/otobus\)"
TIP = r"ihbar\s+alindi|bir\s+ihbara\s+gore|bir\s+kaynak"
SINGULAR = r"\b(?:kamyonet|kamyon|minibus|otobus|otomobil|panelvan|van|arac)(?:$|[^l]|l(?:$|[^ae])|l[ae](?:$|[^r]))"
MOTIONS = (
    ("toward_base", r"usse\s+(dogru\s+ilerleyen|gelen)"),
    ("receding", r"bolgeden\s+uzaklasiyor"),
    ("moving", r"transit\s+geciyor|ilerliyor"),
    ("stopped", r"durdugu|beklemede|bekliyor|hareketsiz|park\s+halinde|yerinden\s+ayrilmadi"),
)
STILL_FOR = ((60, r"bir\s+saatten\s+uzun"), (30, r"uzun\s+suredir"))

CONTEXT = ("irrelevant", "area_wide", "unverified", "degraded_coverage")


def fold(text: Column) -> Column:
    """Lower case without accents, of this language's letters."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def _first(rules, text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for v, p in rules))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def vehicle_word(folded: Column) -> Column:
    """The class of the first word of the vocabulary that begins a word of the text."""
    return _first(((c, rf"\b{w}") for w, c in VEHICLES), folded)


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later ones may refer to often: behind a generator each is evaluated once, and not again for every reference."""
    made = rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.select("*", "_once.*").drop("_once")


def parse(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds lat, lon, zone_id, kind, vehicle_type, count, usual_count, motion, still_for_min, friendly, tip to rows with a text.

    zones: zone_id, zone_no, name; the longest name in the text counts. A null text is of kind irrelevant and claims nothing.
    """
    names = zones.agg(F.sort_array(F.collect_list(F.struct((-F.length("name")).alias("by"), "zone_no", "zone_id", fold(F.col("name")).alias("folded")))).alias("zones"))
    few = names.select("zones")  # one row; its size is that of the zone table, which is a dimension of the exercise
    place = lambda g: _found(F.coalesce("text", F.lit("")), COORDINATES, g)
    out = _once(rows.crossJoin(F.broadcast(few)), {"folded": fold(F.coalesce("text", F.lit(""))), **{f"place_{g}": place(g) for g in range(1, 5)}})
    f = F.col("folded")
    number = lambda g: F.col(f"place_{g}")
    sign = lambda g, minus: F.when(F.upper(number(g)) == minus, -1.0).otherwise(1.0)
    lat, lon = number(1).cast("double") * sign(2, "S"), number(3).cast("double") * sign(4, "W")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    out = _once(out, {
        "lat": F.when(good, lat), "lon": F.when(good, lon), "zone_id": F.get(F.filter("zones", lambda z: f.contains(z["folded"])), F.lit(0))["zone_id"],
        "word": vehicle_word(f), "n_word": _found(f, COUNT_TYPE, 1).cast("int"), "t_word": _first(((c, rf"^{w}$") for w, c in VEHICLES), _found(f, COUNT_TYPE, 2)), "any_motion": _first(MOTIONS, f),
    }).drop("zones", *(f"place_{g}" for g in range(1, 5)))
    located = F.col("lat").isNotNull() | F.col("zone_id").isNotNull()
    kind = F.coalesce(_first(KINDS, f), F.when(~located, "irrelevant").when(F.col("word").isNotNull() | F.col("n_word").isNotNull(), "sighting"), F.lit("unknown"))
    out = _once(out, {"kind": kind})
    k, sighting, claim = F.col("kind"), F.col("kind") == "sighting", F.col("kind").isin("sighting", "identified_friendly")
    counted = F.when(F.col("n_word").isNull(), F.col("word")).when((F.col("t_word") == "vehicle") & (F.col("word") != "vehicle"), F.col("word")).otherwise(F.col("t_word"))
    motion = F.col("any_motion")
    return _once(out, {
        "vehicle_type": F.when(sighting & f.rlike(HEAVY), "heavy").when(k != "density", counted),
        "count": F.when(k == "density", None).when(F.col("n_word").isNotNull(), F.col("n_word")).when(sighting & f.rlike(SINGULAR), 1),
        "usual_count": F.when(k == "density", _found(f, USUAL_COUNT, 1).cast("int")),
        "motion": F.when(claim, motion),
        "still_for_min": F.when(claim & (motion == "stopped"), _first(STILL_FOR, f)),
        "friendly": k == "identified_friendly",
        "tip": sighting & f.rlike(TIP),
    }).drop("folded", "word", "n_word", "t_word", "any_motion")


def needs_model(parsed: DataFrame) -> DataFrame:
    """Reports whose wording the patterns don't cover: unknown ones, and sightings without a place."""
    return parsed.filter((F.col("kind") == "unknown") | ((F.col("kind") == "sighting") & F.col("lat").isNull() & F.col("zone_id").isNull()))


def around(reports: DataFrame, detections: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """reports (image_id, report_id, e_m, n_m) with what is near: n_150, n_50 and those of each class, and up to three track ids, nearest first.

    What is near is looked up once for each place, however many reports name it.
    """
    place = ["image_id", "e_m", "n_m"]
    asked = reports.select("image_id", F.struct("e_m", "n_m").alias("det_id"), "e_m", "n_m").distinct()  # reports of one place share what is near
    gate = cfg.matching.report_gate_m
    seen = pairs(asked, detections.select("image_id", F.struct("det_id", "cls").alias("track_id"), "e_m", "n_m"), gate)
    near, cls = F.col("dist_m") <= cfg.matching.claim_radius_m, F.col("track_id.cls")
    counts = seen.groupBy("image_id", "det_id").agg(F.count("*").alias("n_150"), F.count_if(near).alias("n_50"), *(F.count_if(near & (cls == c)).alias(f"n_{c}") for c in ("car", "van", "truck", "bus")))
    by = pairs(asked, tracks, gate)
    linked = by.groupBy("image_id", "det_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist_m", "track_id"))), 1, 3).alias("t")).select("image_id", "det_id", F.transform("t", lambda x: x["track_id"]).alias("tracks"))
    found = written(counts.join(linked, ["image_id", "det_id"], "full").select("image_id", "det_id.*", *(c for c in counts.columns if c.startswith("n_")), "tracks"), "places")
    return reports.join(found, place, "left").fillna(0, ["n_150", "n_50", "n_car", "n_van", "n_truck", "n_bus"])


def _check(claim: str, result: Column | str) -> Column:
    return F.struct(F.lit(claim).alias("claim"), (result if isinstance(result, Column) else F.lit(result)).alias("result"))


def located_checks() -> Column:
    """Array of (claim, result) of a located report with its claims, what is around, and motion_result (null: nothing to hold it to)."""
    c, passed = F.col, lambda x: F.when(x, "pass").otherwise("fail")
    heavy = c("n_truck") + c("n_bus")
    typed = c("vehicle_type").isNotNull() & (c("vehicle_type") != "vehicle")
    fits = F.when(~typed, c("n_50")).when(c("vehicle_type") == "heavy", heavy).when(c("vehicle_type") == "car", c("n_car")).when(c("vehicle_type") == "van", c("n_van")).when(c("vehicle_type") == "truck", c("n_truck")).otherwise(c("n_bus"))
    blind = typed & (c("n_50") == 0)
    return F.when(c("kind") == "density", F.array(_check("density", passed(c("n_150") > F.coalesce("usual_count", F.lit(0)))))).otherwise(F.array_compact(F.array(
        F.when(c("tracks").isNull() & (c("n_50") == 0), _check("presence", "fail")),
        F.when(blind, _check("type", "untestable")).when(typed, _check("type", passed(fits > 0))),
        F.when(~blind & (c("count") > 1), _check("count", passed(fits >= c("count")))),
        F.when(c("tracks").isNotNull() & c("motion").isNotNull() & c("motion_result").isNotNull(), _check("motion", c("motion_result"))),
        F.when(c("friendly"), _check("identity", "untestable")),
    )))


def sector_checks() -> Column:
    """Of a report that names its frame's sector. Columns: kind, n_seen, n_heavy, n_alarming."""
    c, passed = F.col, lambda x: F.when(x, "pass").otherwise("fail")
    return F.array(
        F.when(c("kind") == "negative_claim", _check("heavy_absent", F.when(c("n_seen") == 0, "untestable").otherwise(passed(c("n_heavy") == 0))))
        .when(c("kind") == "zone_status", _check("calm", F.when(c("n_alarming") > 0, "fail").when(c("n_seen") > 0, "pass").otherwise("untestable")))
        .otherwise(_check("location", "untestable"))
    )


def verdict(checks: Column, kind: Column) -> Column:
    has = lambda what: F.exists(checks, lambda x: x["result"] == what)
    return F.when(kind.isin(*CONTEXT), "context").when(has("fail"), "contradicted").when(has("pass"), "verified").otherwise("unverifiable")


def consistency(verdict_: Column) -> Column:
    return F.when(verdict_ == "context", None).when(verdict_ == "verified", "agrees").when(verdict_ == "contradicted", "contradicts").otherwise("unrelated")


def scenario(verdict_: Column, friendly: Column) -> Column:
    """Which text goes to the human, if any."""
    return F.when(verdict_ == "context", None).when(friendly, F.when(verdict_ == "contradicted", "friendly_claim_contradicted").otherwise("friendly_claim_unconfirmed")).when(verdict_ == "contradicted", "report_contradicted").when(verdict_ == "unverifiable", "unverified_recheck")


def trust(verdict_: Column) -> Column:
    """Policy: reports may add confidence and never lower a level."""
    return F.when(verdict_ == "verified", "supports").when(verdict_ == "contradicted", "ask_human").when(verdict_ == "context", "background").otherwise("do_not_rely")


def motion_results(claims: DataFrame, fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """report_id, moved_m, closed_m, still_min, motion_result. claims: report_id, track_id, t_s, motion, still_for_min.

    Movement is read between the fixes nearest ten minutes before and after the report, either of which may be the one at its
    time. A claim of having stood for some minutes is held to still_min, how long the track had stayed by its place at the report;
    that is looked up for such claims alone.
    """
    w = 600.0
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("which"), F.lit(d).alias("d")) for n, d in (("before", -w), ("at", 0.0), ("after", w)))))
    asked = claims.select("track_id", "report_id", "t_s", parts.alias("p")).select("track_id", F.struct("report_id", "p.which").alias("key"), (F.col("t_s") + F.col("p.d")).alias("target_s"))
    got = as_of_join(asked, fixes, 300.0, nearest=True)
    of = lambda n: F.max(F.when(F.col("key.which") == n, F.col("fix"))).alias(n)
    one = got.groupBy(F.col("key.report_id").alias("report_id")).agg(of("before"), of("at"), of("after")).join(claims.select("report_id", "track_id", "motion", "still_for_min"), "report_id")
    one = written(one, "motion")
    b, a = F.coalesce("before", "at"), F.coalesce("after", "at")
    moved = F.sqrt((a["e_m"] - b["e_m"]) ** 2 + (a["n_m"] - b["n_m"]) ** 2)
    reach = lambda x: F.sqrt(x["e_m"] ** 2 + x["n_m"] ** 2)
    still = cfg.kinematics.stationary_m
    lasts = F.col("at").isNotNull() & (F.col("motion") == "stopped") & (F.col("still_for_min") > 0)
    anchors = one.filter(lasts).select("track_id", "at").distinct()  # many claims may start from one fix
    earlier = anchors.join(fixes.select("track_id", F.struct("t_s", "fix_no").alias("k"), "e_m", "n_m"), "track_id").filter(F.col("k.t_s") <= F.col("at.t_s"))
    away = F.sqrt((F.col("e_m") - F.col("at.e_m")) ** 2 + (F.col("n_m") - F.col("at.n_m")) ** 2) > still
    # The last fix away from the place comes before all those that count; both are found in one pass over sorted pairs.
    order = Window.partitionBy("track_id", "at").orderBy(F.desc("k.t_s"), F.desc("k.fix_no")).rowsBetween(Window.unboundedPreceding, 0)
    stood = earlier.withColumn("left", F.max(away.cast("int")).over(order)).filter("left = 0").groupBy("track_id", "at").agg(((F.max("at.t_s") - F.min("k.t_s")) / 60).alias("stood_min"))
    one = one.join(stood, ["track_id", "at"], "left").withColumns({"still_min": F.when(lasts, F.col("stood_min")), "moved_m": F.when(F.col("at").isNotNull(), moved), "closed_m": F.when(F.col("at").isNotNull(), reach(b) - reach(a))})
    held = F.when((F.col("motion") == "stopped") & (F.col("still_for_min") > 0), F.coalesce("still_min", F.lit(0.0)) >= F.col("still_for_min")).when(F.col("motion") == "stopped", F.col("moved_m") <= still).when(F.col("motion") == "moving", F.col("moved_m") > still).when(F.col("motion") == "toward_base", F.col("closed_m") > still).otherwise(-F.col("closed_m") > still)
    return one.select("report_id", "moved_m", "closed_m", "still_min", F.when(F.col("at").isNull(), "untestable").when(held, "pass").otherwise("fail").alias("motion_result"))


#: Slices of the look-back that reports and frames meet in, lots that the reports of a slice are dealt to, and metres of a cell.
SLICES, LOTS, CELL_M = 8, 4, 300.0
#: Reports, and frames, that are sent in one row; more take several rows.
IN_A_ROW = 256


def _listed(rows: DataFrame, of: str, *by: str) -> DataFrame:
    """by, ids: what is equal in by, listed in rows of bounded length."""
    row = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(of)) - 1) / IN_A_ROW)
    return rows.select(*by, of).withColumn("row", row).groupBy(*by, "row").agg(F.collect_list(of).alias(f"{of}s")).drop("row")


def relevant(reports: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """image_id, report_id of reports filed in the two hours up to a frame's capture that name no other place.

    A report with coordinates counts where they lie in the frame's footprint or within the gate around it, whatever zone it
    names; one with a zone alone where that is the frame's; one without a place everywhere, unless it is irrelevant.
    reports: report_id, t_s, zone_id, kind, located, e_m, n_m. frames: image_id, capture_s, zone_id, west, east, south, north.

    The three sorts of reports meet the frames apart: by slice of time and cell, by slice and zone, by slice. A frame of one to seven
    slices after a report's is within the two hours whatever their seconds, so those of a slice are listed together; in the report's
    own slice and the eighth after it only those of one second are, and are compared. Lists of reports and of frames that can't be
    told apart otherwise are compared once. Pairs are made of two lists as the last step, so they are as many as the rows of the
    result and nothing is sorted or exchanged for them; a report's frames follow each other, which columnar files write short. The
    tasks are dealt out beforehand, as what they read is small beside what they give.
    """
    width, gate = cfg.matching.report_lookback_s, cfg.matching.report_gate_m
    tasks = 4 * reports.sparkSession.sparkContext.defaultParallelism
    slice_ = lambda c: F.floor(F.col(c) * SLICES / width)
    cell = lambda c: F.floor(c / CELL_M).cast("long")
    # A metre more than the gate, so that rounding at a cell's edge loses nothing.
    reach = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - gate - 1), cell(F.greatest(a, b) + gate + 1)))
    in_time = (F.col("t_s") <= F.col("capture_s")) & (F.col("t_s") >= F.col("capture_s") - width)

    def met(said: DataFrame, seen: DataFrame, said_by: tuple[str, ...] = (), seen_by: tuple[str, ...] = (), cells: tuple[dict, dict] = ({}, {}), near: Column | None = None) -> DataFrame:
        keys = ["whole", "slice", "lot", *(cells[0] or said_by)]

        def listed(rows: DataFrame, of: str, time: str, by: tuple[str, ...], laid: dict[str, Column]) -> DataFrame:
            whole = _listed(rows, of, "slice", *by).withColumn("whole", F.lit(True))
            lists = whole.unionByName(_listed(rows, of, "slice", time, *by).withColumn("whole", F.lit(False)), allowMissingColumns=True)
            return functools.reduce(lambda df, c: df.withColumn(c, laid[c]), laid, lists)

        one = listed(said, "report_id", "t_s", said_by, cells[0]).withColumn("lot", F.pmod(F.xxhash64("report_ids"), F.lit(LOTS)).cast("int"))
        before = lambda *ks: F.array(*(F.col("slice") - k for k in ks))
        two = listed(seen, "image_id", "capture_s", seen_by, cells[1]).withColumn("slice", F.explode(F.when(F.col("whole"), before(*range(1, SLICES))).otherwise(before(0, SLICES)))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
        both = one.repartition(tasks, *keys).join(two.repartition(tasks, *keys), keys).filter(F.col("whole") | in_time)
        both = both if near is None else both.filter(near)
        return both.select("image_ids", F.explode("report_ids").alias("report_id")).select(F.explode("image_ids").alias("image_id"), "report_id")

    box = ("west", "east", "south", "north")
    located = F.coalesce(F.col("located"), F.lit(False))
    reports = written(reports.select("report_id", "t_s", "zone_id", "kind", "located", "e_m", "n_m", slice_("t_s").alias("slice")), "reports")  # read by all joins
    frames = frames.withColumn("slice", slice_("capture_s"))
    around = {"cx": reach(F.col("west"), F.col("east")), "cy": reach(F.col("south"), F.col("north"))}
    here = met(reports.filter(located), frames, ("e_m", "n_m"), box, ({"cx": cell(F.col("e_m")), "cy": cell(F.col("n_m"))}, around), box_distance(*map(F.col, ("e_m", "n_m", *box))) <= gate)
    there = met(reports.filter(~located & F.col("zone_id").isNotNull()), frames, ("zone_id",), ("zone_id",))
    return here.unionByName(there).unionByName(met(reports.filter(~located & F.col("zone_id").isNull() & (F.col("kind") != "irrelevant")), frames))


def fold_verdicts(rows: DataFrame) -> DataFrame:
    """report_id, consistency, image_id of its most decisive frame, the first of equals. rows: report_id, image_id, consistency."""
    rank = F.when(F.col("consistency") == "contradicts", 2).when(F.col("consistency") == "agrees", 1).otherwise(0)
    return rows.groupBy("report_id").agg(F.max_by(F.struct("consistency", "image_id"), F.struct(rank, -F.col("image_id"))).alias("x")).select("report_id", "x.*")


def cap(verdict_: Column, verified: str = "CLEAR") -> Column:
    """How far a report alone may raise a vehicle. By policy not at all: a verified one agrees with data that set the level already,
    a contradicted or unverifiable one goes to a person. verified: what a policy grants a verified report instead."""
    return F.when(verdict_ == "verified", verified).otherwise("CLEAR")


def support(rows: DataFrame) -> DataFrame:
    """track_id, cap, report_id: the highest cap that reports give a track they match, with the first report that gives it. Caps of CLEAR give nothing.

    rows: report_id, cap, tracks.
    """
    rank = F.when(F.col("cap") == "ALERT", 2).when(F.col("cap") == "WATCH", 1).otherwise(0)
    each = rows.filter("cap <> 'CLEAR'").select("report_id", "cap", rank.alias("rank"), F.explode("tracks").alias("track_id"))
    return each.groupBy("track_id").agg(F.max_by(F.struct("cap", "report_id"), F.struct("rank", -F.col("report_id"))).alias("x")).select("track_id", "x.*")
