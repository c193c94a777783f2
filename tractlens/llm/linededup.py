"""Operator 9: removes later repeats of line runs, found by winnowing over line hashes.

A window is the shortest run of consecutive lines from some line on that holds at least `words`
words. The line with the smallest hash of a window is its fingerprint. Two places with the same run
of `words` words or more share their first window, hence a fingerprint: it is guaranteed.

1. Fingerprints are counted over the corpus (combined before the shuffle); only repeated ones matter.
2. Their windows, and each window extended by further lines while those stay below `words` words,
   are joined to the repeated fingerprints. A digest of the whole run names it, and the earliest place of
   each digest is found by a combined minimum, so a line that a third of all documents hold costs
   one row per task. Extension to the left needs no rows of its own: a window starts at every line.
3. Every other place of a repeated run is deleted, unless it overlaps the first one.

So a line goes exactly if it lies in a run of at least `words` words that also stands earlier: in a
document with a smaller id (then smaller text digest), or further up in the same one. Only whole
lines match; lines that hold no word are kept and never part of a run. Every run keeps its first
place.

Null and empty texts stay as they are. Rows with a null id come last in the order. Rows that repeat
both id and text count as one document and stay equal. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.llm.common import settled, table

WORDS = 30


def runs_of(text: str | None, words: int = WORDS) -> list[tuple[int, bytes, int, int]]:
    """(fingerprint, digest, first line, last line) of all windows and their extensions."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    spots = [i for i, line in enumerate(lines) if line.split()]
    sizes = [len(lines[i].split()) for i in spots]
    marks = [hashlib.blake2b(lines[i].strip(), digest_size=16).digest() for i in spots]
    order = [int.from_bytes(m[:8], "little", signed=True) for m in marks]
    found = []
    total, stop = 0, 0
    for start in range(len(spots)):
        while stop < len(spots) and total < words:
            total += sizes[stop]
            stop += 1
        if total < words:
            break
        # the window is start..stop-1; longer runs follow while their tail stays short
        least = min(order[start:stop])
        last, tail = stop, 0
        while True:
            digest = marks[start] if last == start + 1 else hashlib.blake2b(b"".join(marks[start:last]), digest_size=16).digest()
            found.append((least, digest, spots[start], spots[last - 1]))
            if last == len(spots) or tail + sizes[last] >= words:
                break
            tail += sizes[last]
            last += 1
        total -= sizes[start]
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds `_text_key`; together with the id it names a document."""
    return docs.withColumn("_text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def line_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All windows and their extensions: fingerprint, run, doc_id, text_key, start, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fingerprint", "run", "doc_id", "text_key", "start", "stop"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [runs_of(t, words) for t in part.column("text").to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                columns = list(zip(*[r for one in lists for r in one])) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.binary()),
                        part.column("doc_id").take(owner),
                        part.column("_text_key").take(owner),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()),
                    ],
                    names,
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs.select("doc_id", "text")).mapInArrow(
        run, f"fingerprint long, run binary, doc_id {id_type}, text_key binary, start int, stop int"
    )


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The later places of repeated runs: doc_id, text_key, start, stop (lines, both included)."""
    runs = settled(line_runs(docs, words))
    repeated = (
        runs.groupBy("fingerprint")
        .agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "text_key", "start")).alias("_a"), F.max(F.struct("doc_id", "text_key", "start")).alias("_b"))
        .where("_a < _b")
        .select("fingerprint")
    )
    suspects = settled(runs.join(repeated, "fingerprint", "left_semi").drop("fingerprint"))
    # a null id comes last
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key", "start", "stop")
    first = (
        suspects.groupBy("run")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .select("run", "first")
    )
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return (
        suspects.join(first, "run")
        .where(~(same & (F.col("start") <= F.col("first.stop"))))
        .select("doc_id", "text_key", "start", "stop")
    )


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of `docs` with the later repeats cut out of `text`, and `lines_removed`."""
    spans = repeated_runs(docs, words).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.struct("start", "stop").alias("_span")
    )
    cuts = spans.groupBy("_id", "_key").agg(F.collect_set("_span").alias("_spans"))
    keyed = _keyed(docs)
    joined = keyed.join(cuts, keyed["doc_id"].eqNullSafe(cuts["_id"]) & (keyed["_text_key"] == cuts["_key"]), "left")
    joined = joined.select(*[keyed[c] for c in docs.columns], "_spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                gone = 0
                if spans:
                    lines = text.split("\n")
                    keep = np.ones(len(lines), bool)
                    for span in spans:
                        keep[span["start"] : span["stop"] + 1] = False
                    # lines without a word inside a run stay
                    kept = [line for line, k in zip(lines, keep) if k or not line.encode("utf-8", "replace").split()]
                    gone = len(lines) - len(kept)
                    text = "\n".join(kept)
                texts.append(text)
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int32())], [*names, "lines_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.IntegerType())])
    return joined.mapInArrow(run, schema)


def op9_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines removed and the digest of what is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id",
        F.col("lines_removed").cast("long").alias("lines_removed"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes_left"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their later repeats; a document that loses all its words goes."""
    cut = without_repeats(docs)
    gone = (F.col("lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else c for c in docs.columns]
    return cut.where(~gone).select(*columns)


QUERIES = {"op9_winnowed_lines": op9_winnowed_lines}
SQL: dict[str, str] = {}
