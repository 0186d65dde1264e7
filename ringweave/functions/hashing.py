"""Deterministic hash scalars: the same for a key whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_64 = 18446744073709551616.0


def _digest(key: Column, salt: str | Column) -> Column:
    return F.sha2(F.concat(salt if isinstance(salt, Column) else F.lit(salt), F.lit("|"), key), 256)


def stable_int(key: Column, salt: str | Column) -> Column:
    """The first 8 bytes of SHA-256 of `salt|key`, unsigned: a decimal, as Spark has no unsigned long."""
    return F.conv(F.substring(_digest(key, salt), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_float(key: Column, salt: str | Column) -> Column:
    """stable_int over 2**64: uniform in [0, 1)."""
    return stable_int(key, salt).cast("double") / F.lit(TWO_64)


def modulo(value: Column, n: int | Column) -> Column:
    return (value % (n if isinstance(n, Column) else F.lit(n)).cast("decimal(20,0)")).cast("long")


def halves(key: Column, salt: str) -> Column:
    """struct(hi, lo): the two 32-bit halves of stable_int, as longs."""
    digest = _digest(key, salt)
    return F.struct(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").alias("lo"))


def slice_ratio(parts: Column, shift: int, bits: int) -> Column:
    """`bits` bits of the 64 at `shift`, as a fraction of what they can hold."""
    if shift >= 32:
        value = F.shiftright(parts["hi"], shift - 32)
    elif shift + bits <= 32:
        value = F.shiftright(parts["lo"], shift)
    else:
        value = F.shiftright(parts["lo"], shift).bitwiseOR(F.shiftleft(parts["hi"], 32 - shift))
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")) / F.lit(float(1 << bits))


def trailing_number(account: Column) -> Column:
    """The integer that an id ends with; without one, a hash of the id."""
    digits = F.regexp_extract(account, "([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(modulo(stable_int(account, "num"), 1 << 31))


def pick(values: list[str], key: Column, salt: str) -> Column:
    """One of `values` by hash."""
    return F.element_at(F.array(*map(F.lit, values)), (modulo(stable_int(key, salt), len(values)) + 1).cast("int"))


def evidence_id(entity_type: Column, entity_id: Column, kind: str | Column, subkey: Column) -> Column:
    """'ev_' and 12 hex digits of SHA-1 over the item's coordinates."""
    return F.concat(F.lit("ev_"), F.substring(F.sha1(F.concat_ws(":", entity_type, entity_id, F.lit(kind) if isinstance(kind, str) else kind, subkey).cast("binary")), 1, 12))
