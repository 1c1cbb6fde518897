"""Model output to JSON that parses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import let, strip


def clean_json(c: str | Column) -> Column:
    """Code fences off, surrounding prose off, a cut tail off, control characters
    to blanks."""
    return let(strip(c), lambda raw: let(_unfenced(raw), _object_part))


def _unfenced(raw: Column) -> Column:
    return F.when(
        raw.startswith("```"),
        F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```\s*$", ""),
    ).otherwise(raw)


def _object_part(fenced: Column) -> Column:
    first = F.instr(fenced, "{")
    last = F.length(fenced) - F.instr(F.reverse(fenced), "}") + 1
    has_end = F.instr(fenced, "}") > 0
    prose = ~fenced.startswith("{") & ~fenced.startswith("[") & (first > 0) & has_end & (last > first)
    begin = F.when(prose, first).otherwise(F.lit(1))
    end = F.when(has_end, last).otherwise(F.length(fenced))
    body = F.substring(fenced, begin, end - begin + 1)
    return F.regexp_replace(body, r"[\x00-\x1f]", " ")


def clamp2(c: Column) -> Column:
    """Into 0..1, two digits."""
    return F.when(c.isNotNull(), F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5) / 100)
