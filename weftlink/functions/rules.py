"""Small decisions as column expressions: thresholds, model names, error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLI_FLOOR
from .text import is_blank

# The providers a scorer's name can begin with, and those that are paid for.
PROVIDERS = ("ollama", "openai", "anthropic", "claude", "zai", "minimax")
PAID = ("openai", "anthropic", "claude", "zai", "minimax")
ACCENTS = "áéíóúñ"


def blank(c: Column) -> Column:
    return is_blank(c)


def threshold(asked: float, floor: float | None = CLI_FLOOR) -> float:
    """The threshold asked for, raised to a floor; None: as asked."""
    return asked if floor is None else max(asked, floor)


def accepted(confidence: Column, least: Column | float) -> Column:
    return F.coalesce(confidence >= least, F.lit(False))


def is_cloud(model: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return low.endswith(":cloud") | low.endswith("-cloud")


def is_embedding(model: Column) -> Column:
    return F.lower(F.coalesce(model, F.lit(""))).contains("embed")


def model_tier(model: Column) -> Column:
    """paid by provider; free by suffix; local otherwise; null for blank names and embedding models."""
    low = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    paid = F.substring_index(low, ":", 1).isin(*PAID) & low.contains(":")
    return F.when(blank(model) | is_embedding(model), F.lit(None)).when(paid, "paid").when(is_cloud(model) | low.contains(":free") | low.endswith("/free"), "free").otherwise("local")


def provider_and_model(name: Column) -> Column:
    """Split at the first colon; what isn't a known provider belongs to the model, whose provider is ollama then. A provider
    without a model is an error."""
    first, rest = F.lower(F.trim(F.substring_index(name, ":", 1))), F.trim(F.regexp_extract(name, r"^[^:]*:(.*)$", 1))
    known = name.contains(":") & first.isin(*PROVIDERS)
    wrong = F.raise_error(F.concat(F.lit("no model for provider "), first)).cast("string")
    return F.struct(F.when(known, first).otherwise(F.lit("ollama")).alias("provider"), F.when(known & (rest == ""), wrong).when(known, rest).otherwise(name).alias("model"))


def models_to_unload(running: DataFrame, required: str, col: str = "model") -> DataFrame:
    """Local running models but the required one, each once in any case; none if a cloud model or nothing is required."""
    need = (required or "").strip().lower()
    if not need or need.endswith((":cloud", "-cloud")):
        return running.where("false").select(col)
    kept = running.where(~blank(F.col(col)) & ~is_cloud(F.col(col)) & (F.lower(col) != need))
    return kept.groupBy(F.lower(col).alias("k")).agg(F.min(col).alias(col)).select(col)


def error_category(reference: Column, photo: Column) -> Column:
    """Why two names differ: one holds the other; accents; the first name twice; anything else."""
    first = F.element_at(F.filter(F.split(reference, r"\s+"), lambda w: w != ""), 1)
    twice = photo.contains(F.concat(first, F.lit(" "), first))
    return (
        F.when(photo.contains(reference) | reference.contains(photo), "missing_middle_name").when(photo.rlike(f"[{ACCENTS}]"), "encoding")
        .when(F.coalesce(twice, F.lit(False)), "duplicate").otherwise("other")
    )


def unmapped(extracted: Column, mapped: Column) -> Column:
    return F.greatest(F.lit(0), extracted - mapped)


def output_profile(name: str | None, settings: dict[str, str], folder: str) -> str:
    """The output folder of a profile: test or prod, by a setting of its name or as a folder below `folder`."""
    if not name:
        return folder
    if name.lower() not in ("test", "prod"):
        raise ValueError(f"unknown output profile {name}")
    return settings.get(name.lower()) or f"{folder.rstrip('/')}/{name.lower()}"
