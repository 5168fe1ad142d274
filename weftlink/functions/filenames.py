"""Structured file names: detection by known layouts, templates, and the records they give."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import full_name

IMAGE = r"\.(?:png|jpg|jpeg|bmp)$"
# The layouts in the order in which they are tried, and which group holds what (0: nothing).
LAYOUTS = [
    (r"^(\d+)_([^_]+)_([^.]+)", 1, 2, 3),
    (r"^([^-]+)-([^-]+)-(\d+)", 3, 2, 1),
    (r"^([^,]+),\s*([^-]+)\s*-\s*(\d+)", 3, 1, 2),
    (r"^([^_]+)_([^_]+)_position_(\d+)", 3, 1, 2),
    (r"^(\d+)-([^-]+)-([^.]+)", 1, 3, 2),
    (r"^([^_]+)_([^_]+)_(\d+)", 3, 2, 1),
    (r"^(\d+)", 1, 0, 0),
    (r"^_+([^_]+)_([^_]+)_(\d+)", 3, 2, 1),
    (r"^([^;\s]+)\s+([^;\s]+)\s*;\s*(\d+)", 3, 1, 2),
    (r"^_?([^_]+)_?(\d+)", 2, 0, 1),
]


def record(name: Column, regex: str, ident: int, family: int, sur: int, source: str, used: str) -> Column:
    part = lambda k: F.regexp_extract(name, regex, k) if k else F.lit("")
    fam, first = part(family), part(sur)
    return F.struct(part(ident).alias("external_id"), full_name(fam, first).alias("full_name"), fam.alias("family_name"), first.alias("sur_name"), F.lit(source).alias("source"), F.lit(used).alias("pattern_used"))


def auto_detect(name: Column) -> Column:
    """The record of the first layout that fits; null if none does. A part that the layout lacks is the empty text."""
    out = [F.when(name.rlike(f"(?i){regex}{IMAGE}"), record(name, f"(?i){regex}{IMAGE}", *at, "AutoDetect", f"layout {k}")) for k, (regex, *at) in enumerate(LAYOUTS, 1)]
    return F.coalesce(*out)


def template_regex(template: str) -> tuple[str, dict[str, int]] | None:
    """A template's regular expression and its groups by part; None if it isn't one. Only dots are escaped."""
    kinds = {"id": ("id", r"\d+"), "first": ("sur", "[^{}_]+"), "last": ("family", "[^{}_]+"), "family": ("family", "[^{}_]+"), "sur": ("sur", r"[^{}\.]+")}
    groups: dict[str, int] = {}
    regex, seen = "", 0
    for piece in re.split(r"(\{(?:id|first|last|family|sur)\})", template):
        if piece[1:-1] in kinds and piece[:1] == "{":
            part, body = kinds[piece[1:-1]]
            seen += 1
            groups.setdefault(part, seen)
            regex += f"({body})"
        else:
            seen += len(re.findall(r"(?<!\\)\((?!\?)", piece))
            regex += piece.replace(".", r"\.")
    if "{" in re.sub(r"\[\^\{\}_?(\\\.)?\]", "", regex) and not re.fullmatch(r"[^{]*(\{\d+(,\d*)?\}[^{]*)*", re.sub(r"\[\^\{\}_?(\\\.)?\]", "", regex)):
        return None
    try:
        re.compile(regex)
    except re.error:
        return None
    return f"(?i)^{regex}$", groups


def with_template(name: Column, template: str) -> Column:
    """The record by a template such as {id}_{last}_{first}.png; null if the name doesn't fit or the template isn't valid."""
    made = template_regex(template)
    if made is None:
        return F.lit(None).cast("struct<external_id:string,full_name:string,family_name:string,sur_name:string,source:string,pattern_used:string>")
    regex, g = made
    return F.when(name.rlike(regex), record(name, regex, g.get("id", 0), g.get("family", 0), g.get("sur", 0), "UserPattern", template))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def best_record(manifest: Column, template: Column, auto: Column) -> Column:
    """Manifest before template before detection; null fields and source Unknown if there is none."""
    unknown = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("external_id", "full_name", "family_name", "sur_name")], F.lit("Unknown").alias("source"), F.lit(None).cast("string").alias("pattern_used"))
    return F.coalesce(manifest, template, auto, unknown)
