"""Configuration, errors and limits of the key-value model."""

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEY, MAX_VALUE = 64 * 1024, 100 * 1024 * 1024


class StoreError(Exception):
    """What a store refuses."""


class NotFound(StoreError):
    """A branch, commit, table, namespace or index that isn't there."""


class MergeConflict(StoreError):
    """Unresolved conflicts; ``conflicts`` is their DataFrame."""

    def __init__(self, conflicts: DataFrame) -> None:
        super().__init__("the branches changed the same keys differently")
        self.conflicts = conflicts


@dataclass(frozen=True)
class TreeConfig:
    """Parameters of content-defined chunking; equal sets under equal parameters have equal roots."""

    base: int = 257
    modulus: int = 1_000_000_007
    min_chunk: int = 8
    max_chunk: int = 4096
    pattern: int = 0xFF

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "TreeConfig":
        return TreeConfig(**json.loads(text))


def valid_entry(key: Column, value: Column) -> Column:
    """Whether a key has 1 to 65 536 bytes and a value at most 100 MiB; an empty value is legal."""
    return F.coalesce(F.octet_length(key).between(1, MAX_KEY), F.lit(False)) & F.coalesce(F.octet_length(value) <= MAX_VALUE, F.lit(True))


def validated(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``df``; the query fails at the first entry that breaks the limits."""
    ok = valid_entry(F.col(key), F.col(value))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a key must have 1 to 65536 bytes, a value at most 100 MiB")).cast("boolean")))
