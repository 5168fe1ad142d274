"""Faces, eyes and crops as column expressions over nested points and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a portrait is framed.
DEFAULT_WIDTH, DEFAULT_HEIGHT = 200, 300
EYE_LINE, FACE_LINE, EYE_SHARE = 0.35, 0.41, 0.45
WIDTH_PER_EYES, HEIGHT_PER_EYES = 2.15, 3.70
FACE_WIDTH_SHARE, FACE_HEIGHT_SHARE, LEAST_VISIBLE = 0.32, 0.22, 1.05
LEAST_RATIO, MOST_RATIO = 0.03, 0.60
NO_FACE_HEIGHT, NO_FACE_EYES, ONE_EYE_HEIGHT, ONE_EYE_SHIFT = 0.22, 0.12, 0.35, 0.15
FACE_EYES, LEFT_EYE, RIGHT_EYE = 0.40, 0.30, 0.70
ASPECT_SLACK, LEAST_SCALE, LEAST_FRAME = 0.01, 0.05, 20
THUMB_WIDTH, THUMB_HEIGHT = 160, 80


def whole(c: Column) -> Column:
    """Towards zero."""
    return c.cast("int")


def nearest(c: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.rint(c).cast("int")


def up(c: Column) -> Column:
    return F.ceil(c).cast("int")


def half(c: Column) -> Column:
    """Half of a whole number, towards zero."""
    return F.when(c < 0, -F.floor(-c / 2)).otherwise(F.floor(c / 2)).cast("int")


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(c, lit(high)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def scaled(value: Column, size: Column) -> Column:
    """A place in pixels: fractions between 0 and 1 are shares of the size, all else is pixels already."""
    return F.when((value > 0) & (value < 1), whole(value * size)).otherwise(whole(value))


def eye_distance(a: Column, b: Column) -> Column:
    dx, dy = (a["x"] - b["x"]).cast("double"), (a["y"] - b["y"]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def eye_midpoint(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), point(half(a["x"] + b["x"]), half(a["y"] + b["y"])))


def landmark_error(found: Column, face: Column, left: Column, right: Column, width: Column, height: Column) -> Column:
    """Why a detection can't be right; null if it can. Nothing found is fine."""
    inside = lambda p: (p["x"] >= face["x"]) & (p["x"] <= face["x"] + face["width"]) & (p["y"] >= face["y"]) & (p["y"] <= face["y"] + face["height"])
    wide, high = face["width"].cast("double") / width, face["height"].cast("double") / height
    odd = lambda r: (r < LEAST_RATIO) | (r > MOST_RATIO)
    return (
        F.when(~F.coalesce(found, F.lit(False)), F.lit(None).cast("string")).when(face.isNull(), "face_detected_without_face_rect")
        .when((face["width"] <= 0) | (face["height"] <= 0), "invalid_face_rect_dimensions")
        .when((face["x"] < 0) | (face["y"] < 0) | (face["x"] + face["width"] > width) | (face["y"] + face["height"] > height), "face_rect_out_of_bounds")
        .when(odd(wide) | odd(high), F.format_string("unrealistic_face_ratio_w%.3f_h%.3f", wide, high))
        .when(left.isNotNull() & ~inside(left), "left_eye_outside_face_rect").when(right.isNotNull() & ~inside(right), "right_eye_outside_face_rect")
        .when(left.isNotNull() & right.isNotNull() & (left["x"] >= right["x"]), "eye_order_invalid")
    )


def scale(frame: Column | int, default: int) -> Column:
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.greatest(F.lit(LEAST_SCALE), frame.cast("double") / default)


def with_crop(rows: DataFrame, frame_w: Column | int = DEFAULT_WIDTH, frame_h: Column | int = DEFAULT_HEIGHT, shift_x: float | None = None, shift_y: float | None = None, out: str = "crop", found: str = "found", face: str = "face", left: str = "left", right: str = "right", width: str = "w", height: str = "h") -> DataFrame:
    """rows with where to crop a portrait: by both eyes and the face, one eye, the face alone, or the upper part of the picture.

    The crop stays within the picture; a shift, in percent of the crop, moves it afterwards, again within the picture. In steps,
    each a projection of its own, so that nothing is worked out twice.
    """
    kept, c = rows.columns, F.col
    wide, high = scale(frame_w, DEFAULT_WIDTH), scale(frame_h, DEFAULT_HEIGHT)
    f, lt, rt, w, h = c(face), c(left), c(right), c(width), c(height)
    rows = rows.withColumns({"__both": lt.isNotNull() & rt.isNotNull() & f.isNotNull(), "__one": lt.isNotNull() | rt.isNotNull(), "__alone": F.coalesce(c(found), F.lit(False)) & f.isNotNull(), "__apart": eye_distance(lt, rt), "__middle": eye_midpoint(lt, rt)})
    both, one, alone, middle = c("__both"), c("__one"), c("__alone"), c("__middle")
    weighed = both & (c("__apart") > 0)
    rows = rows.withColumns({"__fw": F.when(weighed, (f["width"] + c("__apart") * WIDTH_PER_EYES) / 2.0).otherwise(f["width"].cast("double")), "__fh": F.when(weighed, (f["height"] + c("__apart") * HEIGHT_PER_EYES) / 2.0).otherwise(f["height"].cast("double"))})
    share = F.when(one, ONE_EYE_HEIGHT).otherwise(NO_FACE_HEIGHT)
    base_w = F.greatest(F.lit(1), up(c("__fw") / FACE_WIDTH_SHARE))
    tall = F.when(f.isNotNull() & (one | alone), F.greatest(F.lit(1), up(c("__fh") / FACE_HEIGHT_SHARE), up(base_w / F.lit(DEFAULT_WIDTH / DEFAULT_HEIGHT)))).otherwise(F.greatest(F.lit(1), nearest(h * share)))
    rows = rows.withColumns({"__by_face": f.isNotNull() & (one | alone), "__bw": base_w, "__tall": tall})
    broad = nearest(c("__tall") * F.lit(DEFAULT_WIDTH / DEFAULT_HEIGHT))
    rows = rows.withColumn("__broad", F.when(c("__by_face"), F.greatest(c("__bw"), broad)).otherwise(F.greatest(F.lit(1), broad)))
    least = lambda side: F.when(c("__by_face"), F.greatest(F.lit(1), up(c(side) * LEAST_VISIBLE))).otherwise(1)
    rows = rows.withColumns({"__cw": F.greatest(least("__fw"), nearest(c("__broad") * wide)), "__ch": F.greatest(least("__fh"), nearest(c("__tall") * high))})
    aside = whole(c("__cw") * F.lit(ONE_EYE_SHIFT))
    center = F.when(both, middle["x"]).when(one, F.when(lt.isNotNull(), lt["x"] + aside).otherwise(rt["x"] - aside)).when(alone, f["x"] + half(f["width"])).otherwise(half(w))
    eyes = F.when(both, middle["y"]).when(one, F.coalesce(lt["y"], rt["y"])).when(alone, f["y"] + whole(f["height"] * F.lit(FACE_EYES))).otherwise(whole(h * F.lit(NO_FACE_EYES)))
    rows = rows.withColumns({"__cx": center, "__cy": eyes, "__kw": F.least(c("__cw"), w), "__kh": F.least(c("__ch"), h)})
    rows = rows.withColumns({"__by_eyes": c("__cy") - nearest(c("__kh") * F.lit(EYE_LINE)), "__by_middle": nearest((f["y"] + f["height"] / F.lit(2.0)) - c("__kh") * F.lit(FACE_LINE))})
    top = F.when(f.isNull(), c("__by_eyes")).otherwise(nearest(c("__by_eyes") * F.lit(EYE_SHARE) + c("__by_middle") * F.lit(1.0 - EYE_SHARE)))
    room_w, room_h = w - c("__kw"), h - c("__kh")
    rows = rows.withColumns({"__x": clamp(c("__cx") - half(c("__kw")), F.lit(0), room_w), "__y": clamp(top, F.lit(0), room_h)})
    if shift_x is not None:
        rows = rows.withColumn("__x", clamp(c("__x") + nearest(c("__kw") * F.lit(shift_x / 100.0)), F.lit(0), room_w))
    if shift_y is not None:
        rows = rows.withColumn("__y", clamp(c("__y") + nearest(c("__kh") * F.lit(shift_y / 100.0)), F.lit(0), room_h))
    return rows.select(*[c(k) for k in kept if k != out], rect(c("__x"), c("__y"), c("__kw"), c("__kh")).alias(out))


def aspect_trim(crop: Column, width: Column | int, height: Column | int) -> Column:
    """crop cut to the aspect of the output: from the bottom if it is too narrow, from both sides if it is too wide."""
    lit = lambda s: s if isinstance(s, Column) else F.lit(s)
    want, is_ = lit(width).cast("double") / lit(height), crop["width"].cast("double") / crop["height"]
    tall = F.least(F.greatest(F.lit(1), nearest(crop["width"] / want)), crop["height"])
    broad = F.least(F.greatest(F.lit(1), nearest(crop["height"] * want)), crop["width"])
    aside = F.greatest(F.lit(0), half(crop["width"] - broad))
    return F.when(F.abs(is_ - want) <= ASPECT_SLACK, crop).when(is_ < want, rect(crop["x"], crop["y"], crop["width"], tall)).otherwise(rect(crop["x"] + aside, crop["y"], broad, crop["height"]))


def estimated_eyes(face: Column, width: Column, height: Column) -> Column:
    """(left, right) where eyes usually are in a face, within the picture."""
    y = clamp(face["y"] + whole(face["height"] * F.lit(FACE_EYES)), F.lit(0), height - 1)
    at = lambda share: point(clamp(face["x"] + whole(face["width"] * F.lit(share)), F.lit(0), width - 1), y)
    return F.struct(at(LEFT_EYE).alias("left"), at(RIGHT_EYE).alias("right"))


def decode_box(detections: Column, width: Column, height: Column, least: float = 0.7) -> Column:
    """The surest of an array of detections (confidence, left, top, right, bottom as shares) as (face, confidence); null if none
    is sure enough. Of equals the first counts."""
    sure = F.filter(detections, lambda d: d["confidence"] >= least)
    ranked = F.transform(sure, lambda d, k: F.struct(d["confidence"].alias("c"), (-k).alias("k"), d.alias("d")))
    best = F.array_max(ranked)["d"]
    x, y = best["left"] * width, best["top"] * height
    box = rect(whole(x), whole(y), whole(best["right"] * width - x), whole(best["bottom"] * height - y))
    return F.when(F.size(sure) > 0, F.struct(box.alias("face"), best["confidence"].cast("double").alias("confidence")))


def decode_grid(cell: Column, width: Column, height: Column, net_w: int, net_h: int, least: float = 0.9) -> Column:
    """A detector's grid cell (stride, row, col, cls, obj, dx, dy, lw, lh, and the eyes' rx, ry, lx, ly) as a box with eyes in
    pixels and its score; null below `least`."""
    score = F.sqrt(clamp(cell["cls"], 0.0, 1.0) * clamp(cell["obj"], 0.0, 1.0))
    sx, sy, stride = width / F.lit(float(net_w)), height / F.lit(float(net_h)), cell["stride"]
    w, h = F.exp(cell["lw"]) * stride, F.exp(cell["lh"]) * stride
    x, y = (cell["col"] + cell["dx"]) * stride - w / 2, (cell["row"] + cell["dy"]) * stride - h / 2
    across = lambda v: clamp(v * sx, F.lit(0.0), width - 1.0)
    down = lambda v: clamp(v * sy, F.lit(0.0), height - 1.0)
    eye = lambda ex, ey: F.struct(across((cell[ex] + cell["col"]) * stride).alias("x"), down((cell[ey] + cell["row"]) * stride).alias("y"))
    box = F.struct(across(x).alias("x"), down(y).alias("y"), clamp(w * sx, F.lit(1.0), width).alias("width"), clamp(h * sy, F.lit(1.0), height).alias("height"))
    return F.when(score >= least, F.struct(box.alias("box"), eye("rx", "ry").alias("right_eye"), eye("lx", "ly").alias("left_eye"), score.alias("score")))


def largest_face(faces: Column, least: int = 50) -> Column:
    """Of an array of rectangles the one of the largest area, at least `least` pixels each way; the first of equals."""
    kept = F.filter(faces, lambda f: (f["width"] >= least) & (f["height"] >= least))
    return F.array_max(F.transform(kept, lambda f, k: F.struct((f["width"] * f["height"]).alias("a"), (-k).alias("k"), f.alias("f"))))["f"]


def surest_face(faces: Column) -> Column:
    """Of an array of (face, confidence) the one with the largest area times confidence, which counts as 0.1 at least."""
    weight = lambda f: f["face"]["width"] * f["face"]["height"] * F.greatest(f["confidence"], F.lit(0.1))
    return F.array_max(F.transform(faces, lambda f, k: F.struct(weight(f).alias("a"), (-k).alias("k"), f.alias("f"))))["f"]


def merged_eyes(eyes: Column, least: int = 20) -> Column:
    """Eye rectangles of at least `least` pixels, each joined with the first one kept so far that it overlaps, left to right; the
    leftmost two are the eyes."""
    kept = F.filter(eyes, lambda e: (e["width"] >= least) & (e["height"] >= least))
    meets = lambda a, b: (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])

    def union(a: Column, b: Column) -> Column:
        x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
        return rect(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)

    def add(done: Column, e: Column) -> Column:
        hit = F.array_min(F.transform(F.filter(F.transform(done, lambda d, k: F.struct(k.alias("k"), d.alias("d"))), lambda s: meets(s["d"], e)), lambda s: s["k"]))
        rest = F.filter(done, lambda d, k: k != hit)
        return F.when(hit.isNull(), F.concat(done, F.array(e))).otherwise(F.concat(rest, F.array(union(F.get(done, hit), e))))

    plain = F.transform(kept, lambda e: rect(e["x"], e["y"], e["width"], e["height"]))
    return F.array_sort(F.aggregate(plain, F.array().cast("array<struct<x:int,y:int,width:int,height:int>>"), add))


def locked_frame(width: Column | None, height: Column | None, out_w: Column | int, out_h: Column | int) -> Column:
    """The other side of a crop frame that keeps the output's aspect: give one of width and height."""
    lit = lambda s: s if isinstance(s, Column) else F.lit(s)
    w, h = F.greatest(F.lit(1), lit(out_w)).cast("double"), F.greatest(F.lit(1), lit(out_h)).cast("double")
    return F.greatest(F.lit(LEAST_FRAME), nearest(width * (h / w)) if width is not None else nearest(height * (w / h)))


def thumbnail(width: Column, height: Column) -> Column:
    aspect = width.cast("double") / height
    wide = aspect > THUMB_WIDTH / THUMB_HEIGHT
    return F.struct(F.when(wide, THUMB_WIDTH).otherwise(whole(F.lit(THUMB_HEIGHT) * aspect)).alias("width"), F.when(wide, whole(F.lit(THUMB_WIDTH) / aspect)).otherwise(THUMB_HEIGHT).alias("height"))
