"""Geographic column expressions, and joins by distance and time as equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Fixed values of the WGS84 spheroid: half axes in metres and flattening.
AXIS_M, FLATTENING = 6_378_137.0, 1 / 298.257223563
POLAR_M = AXIS_M * (1 - FLATTENING)


def spheroid_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 12) -> Column:
    """Distance in metres on the spheroid by Vincenty's inverse formula, to a millimetre; points almost opposite one another, where it doesn't converge, are measured on the sphere."""
    u1, u2 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1))), F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))
    turn = lon2 - lon1
    wide = F.radians(turn - 360 * F.floor((turn + 180) / 360))
    given = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), wide.alias("l"))

    def terms(g: Column, angle: Column) -> dict[str, Column]:
        x, y = g["c2"] * F.sin(angle), g["c1"] * g["s2"] - g["s1"] * g["c2"] * F.cos(angle)
        sine, cosine = F.sqrt(x * x + y * y), g["s1"] * g["s2"] + g["c1"] * g["c2"] * F.cos(angle)
        alpha = F.when(sine == 0, 0.0).otherwise(g["c1"] * g["c2"] * F.sin(angle) / sine)
        rest = 1 - alpha * alpha
        middle = F.when(rest < 1e-12, 0.0).otherwise(cosine - 2 * g["s1"] * g["s2"] / rest)  # 0 along the equator
        return {"sine": sine, "cosine": cosine, "sigma": F.atan2(sine, cosine), "alpha": alpha, "rest": rest, "middle": middle}

    def step(state: Column, _: Column) -> Column:
        g, k = state["g"], terms(state["g"], state["a"])
        c = FLATTENING / 16 * k["rest"] * (4 + FLATTENING * (4 - 3 * k["rest"]))
        to = g["l"] + (1 - c) * FLATTENING * k["alpha"] * (k["sigma"] + c * k["sine"] * (k["middle"] + c * k["cosine"] * (2 * k["middle"] * k["middle"] - 1)))
        return F.struct(g.alias("g"), to.alias("a"), F.abs(to - state["a"]).alias("moved"))

    def length(state: Column) -> Column:
        k = terms(state["g"], state["a"])
        u = k["rest"] * (AXIS_M**2 - POLAR_M**2) / POLAR_M**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = k["middle"]
        part = b * k["sine"] * (m + b / 4 * (k["cosine"] * (2 * m * m - 1) - b / 6 * m * (4 * k["sine"] * k["sine"] - 3) * (4 * m * m - 3)))
        return F.when(state["moved"] < 1e-11, POLAR_M * a * (k["sigma"] - part))

    start = F.struct(given.alias("g"), wide.alias("a"), F.lit(1.0).alias("moved"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, length), haversine_m(lat1, lon1, lat2, lon2))


def angle_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two directions from the earth's centre."""
    cosine = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon1 - lon2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """(lat, lon) at a share of the way along the great circle."""
    w = F.radians(angle_deg(lat1, lon1, lat2, lon2))
    a = F.when(F.sin(w) == 0, 1 - share).otherwise(F.sin((1 - share) * w) / F.sin(w))
    b = F.when(F.sin(w) == 0, share).otherwise(F.sin(share * w) / F.sin(w))
    la, lb, oa, ob = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    x = a * F.cos(la) * F.cos(oa) + b * F.cos(lb) * F.cos(ob)
    y = a * F.cos(la) * F.sin(oa) + b * F.cos(lb) * F.sin(ob)
    z = a * F.sin(la) + b * F.sin(lb)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside min lon, min lat, max lon, max lat, edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def parse_box(text: str) -> tuple[float, float, float, float]:
    try:
        box = tuple(float(x) for x in text.split(","))
    except ValueError as e:
        raise ValueError("bbox takes min lon, min lat, max lon, max lat") from e
    if len(box) != 4:
        raise ValueError("bbox takes min lon, min lat, max lon, max lat")
    return box


def centre_distances(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Place in metres from the earth's centre: no pole and no date line."""
    return (
        EARTH_M * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        EARTH_M * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        EARTH_M * F.sin(F.radians(lat)),
    )


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, microseconds kept."""
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def celled(probe: DataFrame, build: DataFrame, prefix: str, radius: Column | float, radii: list[float], before_s: float, after_s: float, least: Column | None = None, room: float = 1.0) -> tuple[DataFrame, DataFrame, Column, Column]:
    """(probe rows by the cells that their reach touches, build rows by the cells that they stand in, equality of cells, nearness): what near_pairs and near_any join.

    least: the smallest of the radii for which a build row is looked for, a column of it. room: how much longer a distance on the sphere may be than the one that decides.
    """
    span = max(before_s + after_s, 1.0)
    reach = radius if isinstance(radius, Column) else F.lit(float(radius))
    size = F.lit(2.0 * room) * reach
    floor = lambda c: F.floor(c).cast("long")
    p = probe.withColumns({"_reach": reach.cast("double"), "_r": reach.cast("double") * room}).withColumns(dict(zip(("_px", "_py", "_pz"), centre_distances(F.col("lat"), F.col("lon")), strict=True))).withColumn("_ps", seconds(F.col("t")))
    for axis in "xyz":
        p = p.withColumn(f"_{axis}", F.explode(F.sequence(floor((F.col(f"_p{axis}") - F.col("_r")) / size), floor((F.col(f"_p{axis}") + F.col("_r")) / size))))
    p = p.withColumn("_t", F.explode(F.sequence(floor((F.col("_ps") - before_s) / span), floor((F.col("_ps") + after_s) / span))))
    b = build.select(*[F.col(c).alias(prefix + c) for c in build.columns], *([least.alias("_least")] if least is not None else []))
    sizes = F.array(*[F.lit(float(r)) * room for r in sorted(set(radii))])
    b = b.withColumn("_br", F.explode(sizes if least is None else F.filter(sizes, lambda r: r >= F.col("_least") * room))).drop("_least")
    b = b.withColumns(dict(zip(("_qx", "_qy", "_qz"), centre_distances(F.col(prefix + "lat"), F.col(prefix + "lon")), strict=True))).withColumn("_qs", seconds(F.col(prefix + "t")))
    for axis in "xyz":
        b = b.withColumn(f"_b{axis}", floor(F.col(f"_q{axis}") / (2.0 * F.col("_br"))))
    b = b.withColumn("_bt", floor(F.col("_qs") / span))
    on = (F.col("_r") == F.col("_br")) & (F.col("_x") == F.col("_bx")) & (F.col("_y") == F.col("_by")) & (F.col("_z") == F.col("_bz")) & (F.col("_t") == F.col("_bt"))
    # a chord is no longer than its arc; a metre of room for rounding, the distance itself decides
    chord = sum(((F.col(f"_p{x}") - F.col(f"_q{x}")) * (F.col(f"_p{x}") - F.col(f"_q{x}")) for x in "xyz"), F.lit(0.0))
    near = (chord <= (F.col("_r") + 1) * (F.col("_r") + 1)) & (F.col("_qs") - F.col("_ps")).between(-before_s, after_s)
    return p, b, on, near


#: A distance on the sphere is longer than that on the spheroid by less than this.
SPHEROID_ROOM = 1.01
OWN = ("_r", "_reach", "_x", "_y", "_z", "_t", "_px", "_py", "_pz", "_ps", "_br", "_bx", "_by", "_bz", "_bt", "_qx", "_qy", "_qz", "_qs")


def near_pairs(probe: DataFrame, build: DataFrame, prefix: str, radius: Column | float, radii: list[float], before_s: float, after_s: float, least: Column | None = None, also: Column | None = None, spheroid: bool = False) -> DataFrame:
    """Rows of probe beside the rows of build (its columns prefixed) within the probe's radius in metres and in [t - before_s, t + after_s], ends included.

    Both have lat, lon and t. radii are the values that radius takes. A cell is twice the radius wide, a time bucket as wide as the interval, so a probe meets at most 8 cells
    and 2 buckets; build rows stand in one cell for each radius (from least on, where given). The join is on equal cells and buckets, the distance is checked after it: a shuffle join
    whose groups are bounded by what is near in space and time, never a nested loop. also is one more condition on both, looked at before the distance. spheroid measures on it in place of the sphere.
    """
    p, b, on, near = celled(probe, build, prefix, radius, radii, before_s, after_s, least, SPHEROID_ROOM if spheroid else 1.0)
    met = p.join(b, on & near & also if also is not None else on & near)
    met = met.withColumn("distance_m", (spheroid_m if spheroid else haversine_m)(F.col("lat"), F.col("lon"), F.col(prefix + "lat"), F.col(prefix + "lon")))
    return met.filter(F.col("distance_m") <= F.col("_reach")).drop(*OWN)


def near_any(probe: DataFrame, build: DataFrame, prefix: str, radius: float, before_s: float, after_s: float, also: Column | None = None) -> DataFrame:
    """Rows of probe with at least one row of build near them, as near_pairs has it: a semi-join, which leaves a row's cell at the first. A row can come out once for each of its cells."""
    p, b, on, near = celled(probe, build, prefix, radius, [radius], before_s, after_s)
    close = haversine_m(F.col("lat"), F.col("lon"), F.col(prefix + "lat"), F.col(prefix + "lon")) <= F.col("_r")
    return p.join(b, on & near & close & also if also is not None else on & near & close, "left_semi").drop(*OWN)
