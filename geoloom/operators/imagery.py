"""Images as tables of pixels and features: quality, masks, metadata, matching plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import sampling

#: Limits of the image measures.
SHADOW, HIGHLIGHT, EDGE = 2, 253, 0.04
CLIPPED, BLURRED, PLAIN, DIRECTED = 0.02, 0.0004, 4.0, 0.75
#: Luminance is kept as a whole number: red, green and blue times these, of 255 * 10,000.
LUMA, WHITE = (2126, 7152, 722), 2_550_000
#: Fixed value: features of overlapping tiles nearer than this are one.
TILE_RADIUS = 2.0


def image_quality(pixels: DataFrame) -> DataFrame:
    """Sharpness, texture, clipping and warnings of images (image, x, y, red, green, blue).

    All sums are of whole numbers, so they don't depend on the order of pixels.
    Neighbours come from windows over single rows and columns of an image. Images
    under three pixels wide or high have no measures of space and no row.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    luma = sum((F.col(c) * w for c, w in zip(("green", "blue"), LUMA[1:])), F.col("red") * LUMA[0]).cast("long")
    p = pixels.withColumn("l", luma)
    dark = (F.col("red") <= SHADOW) & (F.col("green") <= SHADOW) & (F.col("blue") <= SHADOW)
    light = (F.col("red") >= HIGHLIGHT) | (F.col("green") >= HIGHLIGHT) | (F.col("blue") >= HIGHLIGHT)
    plain = p.groupBy("image").agg(F.count("*").alias("n"), F.sum("l").alias("sum_l"), F.count_if(dark).alias("dark"), F.count_if(light).alias("light"))
    bins = p.groupBy("image", F.expr(f"(l * 255 + {WHITE // 2}) div {WHITE}").alias("bin")).agg(F.count("*").alias("k"))
    share = F.col("k") / F.col("n")
    entropy = bins.join(plain.select("image", "n"), "image").groupBy("image").agg(F.round(-F.sum(share * F.log2(share)), 9).alias("entropy"))

    e, s = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    q = p.select("image", "x", "y", "l", F.lag("l").over(e).alias("w"), F.lead("l").over(e).alias("e"))
    around = {f"{a}{b}": f(b).over(s) for a, f in (("n", F.lag), ("s", F.lead)) for b in ("w", "l", "e")}
    q = q.withColumns(around).dropna()
    lap = 4 * F.col("l") - F.col("w") - F.col("e") - F.col("nl") - F.col("sl")
    gx = F.col("ne") - F.col("nw") + 2 * F.col("e") - 2 * F.col("w") + F.col("se") - F.col("sw")
    gy = F.col("sw") + 2 * F.col("sl") + F.col("se") - F.col("nw") - 2 * F.col("nl") - F.col("ne")
    q = q.select("image", lap.alias("lap"), gx.alias("gx"), gy.alias("gy"))
    square = lambda a, b: F.sum(wide(F.col(a)) * wide(F.col(b))).cast("double")
    edge = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")) >= EDGE * 4 * WHITE
    space = q.groupBy("image").agg(
        F.count("*").alias("m"), F.sum("lap").cast("double").alias("lap"), square("lap", "lap").alias("lap2"),
        square("gx", "gx").alias("xx"), square("gx", "gy").alias("xy"), square("gy", "gy").alias("yy"), F.count_if(edge).alias("textured"),
    )
    j = plain.join(entropy, "image").join(space, "image")
    unit = float(4 * WHITE)
    mean = F.col("lap") / F.col("m")
    trace = F.col("xx") + F.col("yy")
    across = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    angle = F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))) * 0.5
    j = j.select(
        "image",
        (F.greatest(F.lit(0.0), F.col("lap2") / F.col("m") - mean * mean) / unit / unit).alias("laplacian_variance"),
        (trace / F.col("m") / unit / unit).alias("tenengrad"),
        F.when(trace > 0, F.least(F.lit(1.0), F.try_divide(across, trace))).otherwise(0.0).alias("coherence"),
        F.pmod(angle, F.lit(180.0)).alias("angle"),
        (F.col("sum_l") / F.col("n") / float(WHITE)).alias("mean_luminance"),
        (F.col("dark") / F.col("n")).alias("shadow"), (F.col("light") / F.col("n")).alias("highlight"),
        "entropy", (F.col("textured") / F.col("m")).alias("textured"),
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("shadow") >= CLIPPED, "shadow_clipping"),
        F.when(F.col("highlight") >= CLIPPED, "highlight_clipping"),
        F.when(F.col("laplacian_variance") < BLURRED, "low_sharpness"),
        F.when(F.col("entropy") < PLAIN, "low_texture"),
        F.when((F.col("coherence") >= DIRECTED) & (F.col("laplacian_variance") < 4 * BLURRED), "directional_blur"),
    ))
    return j.withColumn("warnings", warnings)


def merged_tile_features(features: DataFrame, most: int) -> DataFrame:
    """(image, id, x, y, score): the features of overlapping tiles in their image's frame.

    ``features`` (image, tile, id, x, y, origin_x, origin_y, score, proxy), id unique.
    In order of score (of the proxy, where a score of the image is unknown), then place
    and tile, a feature within ``TILE_RADIUS`` of one kept before is dropped; the
    best ``most`` of an image stay.
    """
    if most < 1:
        raise ValueError("the number of features must be positive")
    known = features.groupBy(F.col("image").alias("own")).agg(F.bool_and(F.col("score").isNotNull()).alias("known"))
    f = features.withColumns({"x": F.col("x") + F.col("origin_x"), "y": F.col("y") + F.col("origin_y")}).join(known, F.col("image").eqNullSafe(F.col("own")))
    value = F.when(F.col("known"), F.col("score")).otherwise(F.col("proxy"))
    f = f.withColumn("key", F.struct((-value).alias("r"), "x", "y", "tile", "id"))
    kept = sampling.spaced(f.select("id", "x", "y", "key", "image"), TILE_RADIUS, "xy", "key", "image", closed=True)
    best = Window.partitionBy("g").orderBy("o")
    out = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return out.select(F.col("g").alias("image"), "id", "o.x", "o.y", (-F.col("o.r")).alias("score"))


def brushed(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """(image, x, y) of the pixels that strokes leave masked.

    ``strokes``: segments (image, ordinal, add, x0, y0, x1, y1, radius) in order. A pixel
    is touched if its centre is within the radius of the segment; the last segment that
    touches a pixel decides. A segment only looks at the pixels of its own box.
    """
    span = lambda a, b, n: F.sequence(
        F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.least(a, b) - F.col("radius")).cast("int"))),
        F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil(F.greatest(a, b) + F.col("radius")).cast("int"))),
    )
    s = strokes.withColumn("x", F.explode(span(F.col("x0"), F.col("x1"), width))).withColumn("y", F.explode(span(F.col("y0"), F.col("y1"), height)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.col("x") + 0.5 - F.col("x0"), F.col("y") + 0.5 - F.col("y0")
    along = F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    off = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
    hit = s.where(off <= F.col("radius") * F.col("radius"))
    return hit.groupBy("image", "x", "y").agg(F.max_by("add", "ordinal").alias("add")).where("add").drop("add")


def mask_words(masked: DataFrame, width: int) -> DataFrame:
    """(image, word, bits): masked pixels as a packed raster, 64 pixels in row order to a word."""
    at = F.col("y").cast("long") * width + F.col("x")
    bit = F.expr(f"shiftleft(1L, cast((y * {width}L + x) % 64 as int))")
    return masked.groupBy("image", F.floor(at / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def masked_pixels(words: DataFrame) -> DataFrame:
    return words.groupBy("image").agg(F.sum(F.bit_count("bits")).alias("n"))


def position_priors(photos: DataFrame) -> DataFrame:
    """Adds the preferred position, whether it is a fixed RTK one, and the prior's sigmas.

    ``photos``: vendor_lat, vendor_lon, vendor_alt (vendor's metadata), lat, lon, alt (EXIF),
    rtk_flag, rtk_lon, rtk_lat, rtk_alt (deviations). The vendor's position goes first if it is
    whole and on the globe, with the EXIF height where it has none.
    """
    ok = F.coalesce(F.col("vendor_lat").between(-90, 90) & F.col("vendor_lon").between(-180, 180), F.lit(False))
    has_rtk = F.coalesce("rtk_lon", "rtk_lat", "rtk_alt").isNotNull() | F.col("rtk_flag").isNotNull()
    flag = F.lower(F.trim(F.coalesce("rtk_flag", F.lit("")))).isin("fixed", "50")
    fine = (F.col("rtk_lon") <= 0.1) & (F.col("rtk_lat") <= 0.1) & F.coalesce(F.col("rtk_alt") <= 0.2, F.lit(True))
    both = F.col("rtk_lon").isNotNull() & F.col("rtk_lat").isNotNull()
    found = ok | (F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return photos.withColumns({
        "prior_lat": F.when(ok, F.col("vendor_lat")).otherwise(F.col("lat")),
        "prior_lon": F.when(ok, F.col("vendor_lon")).otherwise(F.col("lon")),
        "prior_alt": F.when(ok, F.coalesce("vendor_alt", "alt")).otherwise(F.col("alt")),
        "rtk_fixed": F.coalesce(flag & fine, F.lit(False)),
        "sigma_h": F.when(found, F.when(both, F.greatest(F.col("rtk_lon"), F.col("rtk_lat"), F.lit(0.01))).otherwise(25.0)),
        "sigma_v": F.when(found, F.greatest(F.coalesce("rtk_alt", F.lit(50.0)), F.lit(0.02))),
        "source": F.when(found, F.when(has_rtk, "vendor_rtk").otherwise("exif")),
    })


#: Words in a camera's make and model that tell its class, first match first.
DEVICES = (("drone", ("dji",)), ("smartphone", ("apple", "iphone", "google", "pixel", "samsung", "huawei", "xiaomi", "oneplus", "motorola", "sony xperia")), ("action_camera", ("gopro", "insta360")), ("scanner", ("scanner",)))


def device_class(make: Column, model: Column) -> Column:
    """The class of a camera by its make and model."""
    name = F.lower(F.concat(F.coalesce(make, F.lit("")), F.lit(" "), F.coalesce(model, F.lit(""))))
    out = F.when(F.trim(name) == "", "unknown")
    for kind, words in DEVICES:
        out = out.when(reduce(lambda a, b: a | b, [name.contains(w) for w in words]), kind)
    return out.otherwise("system_camera")


def new_images(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, path): an image for each content (path, hash) not yet known (id), named by it; the
    first path stands for copies."""
    ids = found.groupBy(F.concat(F.lit("image-"), F.col("hash")).alias("id")).agg(F.min("path").alias("path"))
    return ids.join(known.select("id"), "id", "left_anti")


#: Profile -> wider pair graph, learned pass gated, large pass gated, longest edge,
#: keypoints a megapixel, pairs in a checkpoint.
PROFILES = {"quality": (False, False, True, 8192, 8000, 32), "robust": (True, False, False, 12000, 12000, 16), "fast": (False, True, True, 2400, 5500, 64)}
EDGE_RANGE, KEYPOINT_RANGE = (1024, 32768), (500, 50000)


def resolved_profiles(requests: DataFrame) -> DataFrame:
    """Requests (profile, images, edge, keypoints; the last two null for the default) with
    their settings, or the ``problem`` that refuses them."""
    spark = requests.sparkSession
    rows = [(k, *v) for k, v in PROFILES.items()]
    table = spark.createDataFrame(rows, "profile string, wide_graph boolean, gate_learned boolean, gate_large boolean, default_edge int, default_keypoints int, pair_block int")
    r = requests.join(F.broadcast(table), "profile", "left")  # a row for each profile
    r = r.withColumns({"edge": F.coalesce("edge", "default_edge"), "keypoints": F.coalesce("keypoints", "default_keypoints")})
    problem = (
        F.when(F.col("default_edge").isNull(), "profile")
        .when(F.col("images") < 2, "too few images")
        .when(~F.col("edge").between(*EDGE_RANGE), "edge")
        .when(~F.col("keypoints").between(*KEYPOINT_RANGE), "keypoints")
    )
    return r.withColumn("problem", problem).drop("default_edge", "default_keypoints")


def matching_passes(resolved: DataFrame) -> DataFrame:
    """One row for each ordered pass (ordinal, backend, condition) of resolved requests."""
    gate = lambda c: F.when(F.col(c), "quality_gate").otherwise("always")
    one = lambda b, c: F.struct(F.lit(b).alias("backend"), c.alias("condition"))
    learned, classic = one("aliked", gate("gate_learned")), one("sift", F.lit("always"))
    tail = (one("dedode", gate("gate_large")), one("dense", F.lit("sparse_exhausted")))
    passes = F.when(F.col("profile") == "fast", F.array(classic, learned, *tail)).otherwise(F.array(learned, classic, *tail))
    good = resolved.where("problem is null")
    return good.select("*", F.posexplode(passes).alias("ordinal", "_p")).select(*resolved.columns, "ordinal", "_p.*")
