"""Readers of sequences by format, for the command line and for formats of one's own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.fasta import read_fasta


class Reader(Protocol):
    """Reads seq_id, name, seq, len of each sequence at a path. on_empty: what sequences without bases do, "drop", "keep" or
    "error"."""

    def __call__(self, spark: SparkSession, path: str, on_empty: str = "drop") -> DataFrame: ...


_READERS: dict[str, Reader] = {"fasta": read_fasta}


def register(name: str, reader: Reader) -> None:
    if name in _READERS:
        raise ValueError(f"there is a reader called {name}")
    _READERS[name] = reader


def names() -> list[str]:
    return sorted(_READERS)


def read_sequences(spark: SparkSession, path: str, on_empty: str = "drop", name: str = "fasta") -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"no reader is called {name}")
    return _READERS[name](spark, path, on_empty)
