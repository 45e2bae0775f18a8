"""Scalar functions as column expressions; exact 64-bit hashes as Arrow functions, since ANSI arithmetic forbids wrapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The syllables of generated last names.
SYLLABLES = ["BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING"]


def last_name(n: Column) -> Column:
    """Three syllables, by the digits of a number from 0 to 999."""
    names = F.array(*map(F.lit, SYLLABLES))
    digit = lambda k: F.pmod(F.floor(n / k), F.lit(10)).cast("int")
    return F.concat(*(F.element_at(names, digit(k) + 1) for k in (100, 10, 1)))


def zero_padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def base36(n: Column, width: int) -> Column:
    return F.lower(F.lpad(F.conv(n.cast("string"), 10, 36), width, "0"))


def history(parts: list[Column], data: Column, longest: int = 500) -> Column:
    """A customer's data with a payment put in front, cut to its longest."""
    return F.left(F.concat(F.concat_ws(" ", *parts), F.lit(" "), data), F.lit(longest))


def packed(columns: list[tuple[Column, int]]) -> Column:
    """Mixed-radix key: each column with its number of values."""
    out = F.lit(0).cast("bigint")
    for c, size in columns:
        out = out * size + c
    return out


def nurand(a: Column, b: Column, low: int, high: int) -> Column:
    """Skewed number from two even ones: (a | b) mod the range, from low."""
    return F.pmod(a.bitwiseOR(b), F.lit(high - low + 1)) + low


def zipf(u: Column, n: int, theta: float) -> Column:
    """Inverse transform of a Zipf distribution over 0 to n - 1; zeta sums come from the driver, once."""
    zeta = float(np.sum(1.0 / np.arange(1, n + 1, dtype=np.float64) ** theta))
    zeta2 = 1 + 0.5**theta
    alpha, eta = 1 / (1 - theta), (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta2 / zeta)
    uz = u * zeta
    rest = F.floor(F.lit(float(n)) * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(uz < 1, F.lit(0).cast("bigint")).when(uz < zeta2, F.lit(1).cast("bigint")).otherwise(F.least(rest, F.lit(n - 1)))


@F.pandas_udf(LongType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a over UTF-8 bytes, as a signed 64-bit number; null stays null. All texts advance together, byte by byte."""
    raw = [None if x is None else x.encode() for x in s]
    size = np.array([len(x or b"") for x in raw], np.int64)
    out = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    grid = np.zeros((len(raw), max(1, int(size.max(initial=0)))), np.uint64)
    for i, x in enumerate(raw):
        grid[i, : size[i]] = np.frombuffer(x or b"", np.uint8)
    for k in range(grid.shape[1]):
        out = np.where(k < size, (out ^ grid[:, k]) * np.uint64(0x100000001B3), out)
    return pd.Series(out.view(np.int64)).astype("Int64").mask(pd.Series([x is None for x in raw]))


@F.pandas_udf(LongType())
def splitmix64(s: pd.Series) -> pd.Series:
    """The published SplitMix64 step of a 64-bit state."""
    z = s.fillna(0).to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64)).astype("Int64").mask(s.isna().reset_index(drop=True))


@F.pandas_udf(LongType())
def lcg48(s: pd.Series) -> pd.Series:
    """One step of the published 48-bit linear congruential generator."""
    x = s.fillna(0).to_numpy(np.int64).view(np.uint64)
    x = (x * np.uint64(0x5DEECE66D) + np.uint64(0xB)) & np.uint64((1 << 48) - 1)
    return pd.Series(x.view(np.int64)).astype("Int64").mask(s.isna().reset_index(drop=True))


def stable_partition(key: Column, partitions: int) -> Column:
    """FNV-1a of the key, unsigned, mod the number of partitions."""
    h = fnv1a64(key)
    # an unsigned remainder from a signed number: 2 ** 64 mod partitions is added to negative ones
    wrap = (1 << 64) % partitions
    return F.pmod(F.pmod(h, F.lit(partitions)) + F.when(h < 0, F.lit(wrap)).otherwise(F.lit(0)), F.lit(partitions))
