"""Geodesy and plane geometry as Column expressions. East and north are metres from the base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH_M = 6_371_008.8


def m_per_deg(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of latitude and of longitude at a latitude (WGS-84 series)."""
    phi = F.radians(lat)
    m_lat = F.lit(111132.92) - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi)
    m_lon = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)
    return m_lat, m_lon


def to_enu(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north of a point; the scale is that of the origin."""
    m_lat, m_lon = m_per_deg(F.lit(lat0))
    return (lon - lon0) * m_lon, (lat - lat0) * m_lat


def to_latlon(e: Column, n: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    m_lat, m_lon = m_per_deg(F.lit(lat0))
    return F.lit(lat0) + n / m_lat, F.lit(lon0) + e / m_lon


def length(e: Column, n: Column) -> Column:
    return F.sqrt(e * e + n * n)


def bearing(e: Column, n: Column) -> Column:
    """Compass bearing in [0, 360); 0 for no vector."""
    return F.when((e == 0) & (n == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0)))


def gsd(frame: DataFrame) -> tuple[Column, Column]:
    """Ground sampling distance across and down, metres per pixel, with the scale of the top latitude."""
    m_lat, m_lon = m_per_deg(frame["lat_top"])
    return F.abs(frame["lon_right"] - frame["lon_left"]) * m_lon / frame["width_px"], F.abs(frame["lat_top"] - frame["lat_bottom"]) * m_lat / frame["height_px"]


def pixel_to_latlon(u: Column, v: Column) -> tuple[Column, Column]:
    """Of rows with a frame's columns: linear in both axes."""
    c = F.col
    return c("lat_top") + (v / c("height_px")) * (c("lat_bottom") - c("lat_top")), c("lon_left") + (u / c("width_px")) * (c("lon_right") - c("lon_left"))


def latlon_to_pixel(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Inverse of the frame's affine map; outside points give pixels outside; null where the frame has no area."""
    c = F.col
    by, ay = c("lat_bottom") - c("lat_top"), c("lon_right") - c("lon_left")
    det = F.lit(0.0) - ay * by
    dlat, dlon = lat - c("lat_top"), lon - c("lon_left")
    ok = F.abs(det) >= 1e-15
    return F.when(ok, (dlat * by * 0 - dlon * by) / det * c("width_px")), F.when(ok, (F.lit(0.0) - ay * dlat) / det * c("height_px"))


def contains(lat: Column, lon: Column) -> Column:
    c = F.col
    return lat.between(F.least(c("lat_top"), c("lat_bottom")), F.greatest(c("lat_top"), c("lat_bottom"))) & lon.between(F.least(c("lon_left"), c("lon_right")), F.greatest(c("lon_left"), c("lon_right")))


def box_distance(e: Column, n: Column, e_lo: Column, e_hi: Column, n_lo: Column, n_hi: Column) -> Column:
    """Distance of a point from a rectangle; 0 inside."""
    zero = F.lit(0.0)
    return length(F.greatest(e_lo - e, zero, e - e_hi), F.greatest(n_lo - n, zero, n - n_hi))


def frame_problems(tolerance: float = 0.05) -> Column:
    """Names of a frame's faults: the first group of checks that finds any ends the list."""
    c = F.col
    size = F.array_compact(F.array(F.when((c("width_px") <= 0) | (c("height_px") <= 0), "size")))
    place = F.array_compact(F.array(*(F.when(~(c(la).between(-90, 90) & c(lo).between(-180, 180)), name) for name, la, lo in (("top_left", "lat_top", "lon_left"), ("top_right", "lat_top", "lon_right"), ("bottom_left", "lat_bottom", "lon_left"), ("bottom_right", "lat_bottom", "lon_right")))))
    order = F.array_compact(F.array(F.when(c("lat_top") <= c("lat_bottom"), "north_south"), F.when(c("lon_right") <= c("lon_left"), "east_west")))
    m_lat, m_lon = m_per_deg(c("lat_top"))
    gx, gy = F.abs(c("lon_right") - c("lon_left")) * m_lon / c("width_px"), F.abs(c("lat_top") - c("lat_bottom")) * m_lat / c("height_px")
    scale = F.array_compact(F.array(F.when((gy > 0) & (F.abs(gx - gy) / gy > tolerance), "gsd_mismatch")))
    return F.when(F.size(size) > 0, size).when(F.size(place) > 0, place).when(F.size(order) > 0, order).otherwise(scale)


def haversine_steps(fixes: DataFrame) -> DataFrame:
    """Great-circle length of each step. fixes: track_id, t_s, fix_no, lat, lon."""
    w = Window.partitionBy("track_id").orderBy("t_s", "fix_no")
    la, lb = F.radians(F.lag("lat").over(w)), F.radians("lat")
    dlo = F.radians(F.col("lon") - F.lag("lon").over(w))
    a = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlo / 2), 2)
    return fixes.withColumn("step_m", 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def crop_window(pad: float, aspect: float) -> dict[str, Column]:
    """Window around a box (x, y, w, h) of a frame (width_px, height_px): padded, grown to the aspect, held inside the frame."""
    c = F.col
    w0, h0 = c("w") + 2 * pad, c("h") + 2 * pad
    w1, h1 = F.greatest(w0, h0 * aspect), F.greatest(h0, w0 / aspect)
    cw, ch = F.least(w1, c("width_px").cast("double")), F.least(h1, c("height_px").cast("double"))
    cx = F.greatest(F.lit(0.0), F.least(c("x") + c("w") / 2 - cw / 2, c("width_px") - cw))
    cy = F.greatest(F.lit(0.0), F.least(c("y") + c("h") / 2 - ch / 2, c("height_px") - ch))
    return {"crop_x": cx, "crop_y": cy, "crop_w": cw, "crop_h": ch}


def half_up(x: Column) -> Column:
    """A score of 0 to 1 as whole hundredths, halves up."""
    return F.floor(x * 100 + 0.5)
