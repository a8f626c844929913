"""Text and number parsing of labels, run names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column | str) -> Column:
    """A double; what is none becomes NaN, not null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def time_bin(c: Column) -> Column:
    """a-b is b, <a is a - 50, >a is a + 100, else the number itself; asked in this order."""
    return (
        F.when(c.contains("-"), F.element_at(F.split(c, "-"), -1).cast("double"))
        .when(c.contains("<"), F.regexp_replace(c, "<", "").cast("double") - 50)
        .when(c.contains(">"), F.regexp_replace(c, ">", "").cast("double") + 100)
        .otherwise(c.cast("double"))
    )


def branch_ends(c: Column) -> tuple[Column, Column]:
    """Both ends of ``u->v``, trimmed; split once."""
    parts = F.split(c, "->", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def branch(a: Column, b: Column) -> Column:
    """``a->b``."""
    return F.concat_ws("->", a, b)


def run_name(c: Column) -> dict[str, Column]:
    """Method and data of ``runtime_<method>_<data>_n<size>_seed<seed>``, and its seed; empty where it does not fit."""
    method = F.regexp_extract(c, r"^runtime_([^_]+)_(.+?)_n\d+", 1)
    data = F.regexp_extract(c, r"^runtime_([^_]+)_(.+?)_n\d+", 2)
    return {"method": method, "data": data, "seed": F.regexp_extract(c, r"_seed(\d+)(?:$|_)", 1)}


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def short_digest(*parts: Column | str) -> Column:
    """The first 16 hex digits of the sha256 of parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256), 1, 16)
