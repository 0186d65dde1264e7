"""Windows of time against events: both are dealt to bins of time, so that only events near a window meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def level(seconds: Column) -> Column:
    """The least power of two that a length reaches in seconds, 0 at least."""
    return F.ceil(F.log2(F.greatest(F.lit(1.0), seconds.cast("double")))).cast("int")


def _bin(at: Column, level_: Column) -> Column:
    return F.floor(F.unix_micros(at) / (F.lit(1e6) * F.pow(F.lit(2.0), level_))).cast("long")


def within(windows: DataFrame, events: DataFrame, key: str, ends: tuple[str, str], at: str) -> DataFrame:
    """windows joined with the events of their key from the first to the last of `ends`, both included; windows that end before they begin have none.

    A window's bins are as long as its length rounded up to a power of two, so it
    lies in two of them, and events get a bin for each length that occurs (some
    tens at the most). One entity with many windows meets each event of a bin only
    with the windows that touch it."""
    low, high = (F.col(e) for e in ends)
    windows = windows.filter(low <= high).withColumn("level", level(F.unix_seconds(high) - F.unix_seconds(low) + 1))
    levels = sorted(r["level"] for r in windows.select("level").distinct().collect())
    if not levels:
        levels = [0]
    dealt = windows.withColumn("bin", F.explode(F.sequence(_bin(low, F.col("level")), _bin(high, F.col("level")))))
    near = events.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bin", _bin(F.col(at), F.col("level")))
    on = [F.col(f"w.{c}") == F.col(f"e.{c}") for c in (key, "level", "bin")] + [F.col(f"e.{at}").between(F.col(f"w.{ends[0]}"), F.col(f"w.{ends[1]}"))]
    both = dealt.alias("w").join(near.alias("e").hint("merge"), on)
    return both.select(*(F.col(f"w.{c}") for c in windows.columns if c != "level"), *(F.col(f"e.{c}") for c in events.columns if c != key))
