"""What the training-data operators share: table access, scratch tables, text units, word tables."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.operators.scale import settled

__all__ = ["table", "settled", "units", "text_groups", "UnitTable", "process_cache", "held_out", "partitions", "freed_shuffles"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a step are deleted as soon as it is written.

    Steps that read each other's results from stored tables need no older shuffle, and the disk
    then holds one step's shuffles at a time. The session's own setting comes back afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def held_out(remainder: int, modulus: int, column: str = "doc_id"):
    """Whether crc32 of the id's decimal text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for tokenizers that are slow to load."""
    name = "_task_objects"
    holder = sys.modules.setdefault(name, types.ModuleType(name))
    return holder.__dict__.setdefault("objects", {})


# every white-space character other than a space or a line feed
_RARE_SPACE = re.compile("[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x00]")
# white space for str.split that is none for bytes.split
OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_UNIT_START = re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> list[str]:
    """Cuts a text before every single space that stands between two visible characters.

    No match of the byte-level pre-token pattern crosses such a place and none looks past it, so
    a text's ids are the ids of its units in order. The units joined give the text.
    """
    plain = not (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[:1] == " "
        or text[-1:] == " "
        or _RARE_SPACE.search(text)
    )
    if plain:
        return text.replace(" ", "\0 ").split("\0")
    return _UNIT_START.split(text)


def text_groups(sizes: Sequence[int], limit: int) -> Iterator[slice]:
    """Runs of neighbouring rows of about `limit` characters; a longer text is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class UnitTable:
    """Integer lists of strings, computed once while they are remembered.

    `encode` maps strings to integer lists. The table forgets everything once it holds
    `capacity` strings, so its memory is bounded; results never depend on what it remembers.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], capacity: int = 250_000, dtype=np.int32):
        self.encode, self.capacity, self.dtype = encode, capacity, dtype
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths = np.zeros(1 << 10, np.int64)
        self.starts = np.zeros(1 << 10, np.int64)
        self.flat = np.zeros(1 << 12, self.dtype)
        self._used = 0

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        """The array, or a copy of at least twice its size."""
        if size <= len(array):
            return array
        larger = np.zeros(max(size, 2 * len(array)), array.dtype)
        larger[: len(array)] = array
        return larger

    def look_up(self, strings: list[str]) -> np.ndarray:
        """Row numbers of the strings in `lengths` and `starts`, valid until the next call."""
        missing = set(strings).difference(self.codes)
        if missing and len(self.codes) + len(missing) > self.capacity:
            self._reset()
            missing = set(strings)
        if missing:
            new = list(missing)
            found = self.encode(new)
            first, last = len(self.codes), len(self.codes) + len(new)
            self.codes.update(zip(new, range(first, last)))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ends = self._used + np.cumsum(lengths)
            self.lengths, self.starts = self._grown(self.lengths, last), self._grown(self.starts, last)
            self.flat = self._grown(self.flat, int(ends[-1]))
            self.lengths[first:last] = lengths
            self.starts[first:last] = ends - lengths
            self.flat[self._used : ends[-1]] = [i for ids in found for i in ids]
            self._used = int(ends[-1])
        return np.fromiter(map(self.codes.__getitem__, strings), np.int64, len(strings))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The lists of the rows, one after the other."""
        return gathered(self.flat, self.starts[codes], self.lengths[codes])


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of `flat`, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
    return flat[places]
