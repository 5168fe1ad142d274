"""Questions to name scorers, and what is read from their answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import landmark_error, point, rect, scaled
from .text import bound, trace_text

ONE = "confidence double, isMatch boolean, reason string"
PLACE = "struct<x double, y double>"
FACE = f"faceDetected boolean, bothEyesDetected boolean, faceRect struct<x double, y double, width double, height double>, leftEye {PLACE}, rightEye {PLACE}, faceCenter {PLACE}, confidence double"
MANY = "results array<struct<index int, confidence double, isMatch boolean, reason string>>"
TASK = "Decide whether two names belong to one person. Word order, spelling, accents, short forms and left-out middle names may differ. "
ASK_ONE = TASK + 'Answer with JSON only: {"confidence": a number from 0 to 1, "isMatch": true or false, "reason": a few words}. Names: '
ASK_MANY = TASK + 'Answer with JSON only: {"results": [{"index": the pair\'s index, "confidence": a number from 0 to 1, "isMatch": true or false, "reason": a few words}]}, one result for each pair. Pairs: '


def ask_one(a: Column, b: Column) -> Column:
    return F.concat(F.lit(ASK_ONE), F.to_json(F.struct(a.alias("name1"), b.alias("name2"))))


def ask_many(pairs: Column) -> Column:
    """pairs: an array of (index, name1, name2)."""
    return F.concat(F.lit(ASK_MANY), F.to_json(pairs))


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such part."""
    return F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))


def any_case(json: Column) -> Column:
    """Keys of an answer, in whatever case, as they are asked for."""
    for key in ("confidence", "isMatch", "reason", "results", "index"):
        json = F.regexp_replace(json, f'(?i)"{key}"\\s*:', f'"{key}":')
    return json


def parse_one(response: Column, least: Column | float, metadata: Column | None = None) -> Column:
    """(confidence, is_match, metadata) of an answer: its JSON, else a number after "confidence", else 0 and an error.

    is_match goes by the threshold; what the model says of it is in the metadata.
    """
    least = F.lit(least) if isinstance(least, int | float) else least
    json = outer_object(F.coalesce(response, F.lit("")))
    data = F.from_json(any_case(json), ONE)
    loose = F.regexp_extract(F.coalesce(response, F.lit("")), r'"confidence":\s*([0-9.]+)', 1).try_cast("double")
    broken = json.isNotNull() & F.try_parse_json(json).isNull()
    state = F.when(broken, "broken").when(json.isNotNull(), "json").when(loose.isNotNull(), "loose").otherwise("none")
    confidence = F.when(state == "json", F.coalesce(data["confidence"], F.lit(0.0))).when(state == "loose", loose).otherwise(0.0)
    error = F.when(state == "broken", "The answer is no valid JSON.").otherwise("The answer can't be read.")
    said = F.create_map(F.lit("reason"), F.coalesce(data["reason"], F.lit("")), F.lit("raw_json"), json, F.lit("model_isMatch"), F.when(F.coalesce(data["isMatch"], F.lit(False)), "True").otherwise("False"))
    failed = F.create_map(F.lit("threshold"), number(least), F.lit("error"), error, F.lit("raw_response"), F.coalesce(response, F.lit("")))
    more = F.when(state == "json", said).when(state == "loose", F.create_map(F.lit("raw_response"), response)).otherwise(failed)
    base = F.create_map().cast("map<string,string>") if metadata is None else F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.struct(confidence.alias("confidence"), ((confidence >= least) & state.isin("json", "loose")).alias("is_match"), F.map_concat(base, more).alias("metadata"))


def parse_many(response: Column) -> Column:
    """A map from index to (confidence, isMatch, reason) of a batch's answer, the last of an index counts; null if it can't be read."""
    read = F.from_json(any_case(outer_object(F.coalesce(response, F.lit("")))), MANY)["results"]
    # bound: what stands in a lambda is worked out again for each element
    return bound(F.filter(read, lambda r: r["index"].isNotNull()), lambda rows: bound(_last_of_each(rows), _by_index))


def _last_of_each(rows: Column) -> Column:
    return F.filter(rows, lambda r, k: ~F.exists(F.slice(rows, k + 2, F.size(rows)), lambda later: later["index"] == r["index"]))


def _by_index(rows: Column) -> Column:
    said = F.transform(rows, lambda r: F.struct(F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"), r["isMatch"].alias("isMatch"), F.coalesce(r["reason"], F.lit("")).alias("reason")))
    return F.when(F.size(rows) > 0, F.map_from_arrays(F.transform(rows, lambda r: r["index"]), said))


def parse_landmarks(response: Column, width: Column, height: Column) -> Column:
    """(face_detected, both_eyes, face, left_eye, right_eye, center, confidence, error) of a vision model's answer, in pixels.

    What stands from the first opening to the last closing brace is read as JSON; fractions count as shares of the picture's size. An answer
    that has no JSON, or none that can be read, or landmarks that can't be right, detects nothing and says why; null reads as no JSON.
    """
    json = outer_object(F.coalesce(response, F.lit("")))
    once = F.struct(json.alias("json"), F.from_json(json, FACE).alias("data"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    return bound(once, lambda said: bound(_placed(said), lambda p: _judged(said, p)))


def _placed(said: Column) -> Column:
    data, width, height = said["data"], said["width"], said["height"]
    at = lambda p: F.when(p.isNotNull(), point(scaled(p["x"], width), scaled(p["y"], height)))
    box, found = data["faceRect"], F.coalesce(data["faceDetected"], F.lit(False))
    face = F.when(found & box.isNotNull(), rect(scaled(box["x"], width), scaled(box["y"], height), scaled(box["width"], width), scaled(box["height"], height)))
    return F.struct(found.alias("found"), face.alias("face"), at(data["leftEye"]).alias("left_eye"), at(data["rightEye"]).alias("right_eye"), at(data["faceCenter"]).alias("center"))


def _judged(said: Column, p: Column) -> Column:
    json, data = said["json"], said["data"]
    wrong = landmark_error(p["found"], p["face"], p["left_eye"], p["right_eye"], said["width"], said["height"])
    error = F.when(json.isNull(), "no_json").when(F.try_parse_json(json).isNull(), "broken_json").otherwise(wrong)
    both = F.coalesce(data["bothEyesDetected"], F.lit(False))
    told = F.struct(p["found"].alias("face_detected"), both.alias("both_eyes"), p["face"].alias("face"), p["left_eye"].alias("left_eye"), p["right_eye"].alias("right_eye"), p["center"].alias("center"), data["confidence"].alias("confidence"), F.lit(None).cast("string").alias("error"))
    kinds = "struct<face_detected boolean, both_eyes boolean, face struct<x int, y int, width int, height int>, left_eye struct<x int, y int>, right_eye struct<x int, y int>, center struct<x int, y int>, confidence double, error string>"
    none = lambda e: F.struct(F.lit(False), F.lit(False), *[F.lit(None)] * 5, e).cast(kinds)
    return bound(error, lambda e: F.when(e.isNull(), told.cast(kinds)).otherwise(none(e)))


def number(c: Column) -> Column:
    """A number with up to three decimals and no more than it needs."""
    return F.regexp_replace(F.format_string("%.3f", c.cast("double")), r"\.?0+$", "")


def trace_line(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[trace_text(p) for p in parts])


def usage(metadata: Column) -> Column:
    """(calls, prompt, completion, total) of one answer: a call counts if a number is stated; without a total it is the sum."""
    key = lambda *names: F.coalesce(*[F.element_at(metadata, n).try_cast("int") for n in names])
    prompt, completion, total = key("usage_prompt_tokens", "usage_input_tokens"), key("usage_completion_tokens", "usage_output_tokens"), key("usage_total_tokens")
    called = F.coalesce(prompt, completion, total).isNotNull()
    both = F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
    return F.struct(called.cast("int").alias("calls"), F.coalesce(prompt, F.lit(0)).alias("prompt"), F.coalesce(completion, F.lit(0)).alias("completion"), F.coalesce(total, both).alias("total"))
