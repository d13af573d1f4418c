"""Token counts: a built-in approximation by characters, or a tokenizer behind an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.6


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class TiktokenFile:
    """A byte-level BPE vocabulary in a file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._own.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self._own.decode(ids)


def approx_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("long")


def token_count(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A Column function; `make` builds the tokenizer once per worker process and batch stream."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else len(tokenizer.encode(t)))

    return count


def trim_to_tokens(text: Column, tokens: int, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """The longest prefix with at most so many approximate tokens."""
    most = int((tokens + 1) * chars_per_token - 1e-9)
    return F.left(text, F.lit(most))
