"""Seeded uniform draws that do not depend on partitioning or retries.

A row gets one 32-bit number from its seed and key (`row_seed`); each
position in the row mixes its index into it with integer arithmetic only, which
stays in generated code and which numpy and SQL reproduce bit for bit.
"""

import numpy as np
from pyspark.sql import Column, functions as F

# An integer hash of 32 bits (xor-shift and multiply, twice).
MASK = 0xFFFFFFFF
MIX = 0x45D9F3B
STEP = 2654435761          # spreads positions
SLOT = 40503 * 65537       # spreads independent draws at one position


def row_seed(seed: int, *keys: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")


def _mix(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX)
    x = x.bitwiseAND(F.lit(MASK))
    return x


def draw(rs: Column, k: Column, slot: int = 0) -> Column:
    """Draw number k of a row: a long in [0, 2^32)."""
    x = (rs + k.cast("long") * F.lit(STEP) + F.lit(slot * SLOT)).bitwiseAND(F.lit(MASK))
    x = _mix(_mix(x))
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw_np(rs, k, slot: int = 0):
    """Same draws for numpy arrays; used inside Arrow functions."""
    x = (np.asarray(rs, np.int64) + np.asarray(k, np.int64) * STEP + slot * SLOT) & MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & MASK
    return x ^ (x >> 16)


def wide_draw(rs: Column, k: Column, slot: int = 0) -> Column:
    """A long in [0, 2^63) from two draws, for picks among very many counts."""
    low = draw(rs, k, slot + 1).bitwiseAND(F.lit(0x7FFFFFFF))
    return draw(rs, k, slot) * F.lit(1 << 31) + low


def slot_of(at: Column, total: Column, slots: Column) -> Column:
    """Which of `slots` equal parts of [0, total) a count falls into. Grows with
    `at`, which is all that picks rely on."""
    return F.least(F.floor(at.cast("double") * (slots / total)).cast("int"), slots - 1)


def pick_entry(at: Column, total: Column, slots: Column) -> Column:
    """Frequency-weighted pick for a count `at` in [0, total). `slots` is
    array<array<struct<hi,..>>>: as many slots as entries, each with the entries
    that reach into it, so a pick looks at about two of them. Pass a plain column
    as `at`: it is named in a lambda."""
    near = F.get(slots, slot_of(at, total, F.size(slots)))
    return F.get(F.filter(near, lambda c: c["hi"] > at), F.lit(0))
