"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, new_path

__all__ = ["LOWER", "SPACES", "SPACE_CLASS", "UPPER", "col", "cut", "drop_cut", "free_names", "held_out", "new_path", "others", "table", "worker_cache"]

#: A-Z, and what they become: lower-casing that leaves all other characters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space of the contracts, as the characters of a regex class and literally.
SPACE_CLASS, SPACES = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df whose names aren't among these, in any letter case."""
    taken = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in taken]


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator remembers in this Python worker. Workers outlive stages: those of other operators are dropped, so that a worker holds one at a time."""
    if others_ := [k for k in _caches if k != owner]:
        for other in others_:
            del _caches[other]
        give_back()
    return _caches.setdefault(owner, {})


def give_back() -> None:
    """Returns memory that Python has freed to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for documents whose crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
