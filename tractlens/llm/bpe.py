"""Operator 3: byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into space-led words that no match of the pre-token pattern crosses (`common.units`).
Every block of documents sends each of its distinct words once, with the positions kept behind;
words meet by hash, each distinct one is encoded once, and its ids go back to the blocks, where texts
are put together by position. The pattern splits inside a word exactly as it does inside the text.

Decoding looks every id up in the table of token bytes, which is as long as the vocabulary (about
50,000 rows, whatever the corpus), so it stays beside the ids as a map-side join.

A null text counts as empty: no ids. Repeated rows and null ids are encoded like any other row. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import gathered, partitions, table, units
from tractlens.llm.fertility import rank_encoding, rank_path
from tractlens.llm.wordblocks import TEXTS, blocks, pack_numbers, unpack_numbers, unpack_strings


def _words(text: str) -> list[bytes]:
    return [u.encode("utf-8", "replace") for u in units(text)] if text else []


def encoded_words(packed: DataFrame, path: str, parts: int) -> DataFrame:
    """(partition, block, bucket, lengths, ids): the ids of every packed row of words.

    A bucket's rows come together in one task, which encodes each distinct word of it once.
    """

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        known: dict[bytes, tuple[int, ...]] = {}
        bucket = None
        for batch in groups:
            for k in range(batch.num_rows):
                if batch.column("bucket")[k].as_py() != bucket:
                    bucket = batch.column("bucket")[k].as_py()
                    known = {}
                words = unpack_strings(batch.column("words")[k].as_py())
                for w in set(words).difference(known):
                    known[w] = tuple(encoding.encode_ordinary(w.decode("utf-8")))
                found = list(map(known.__getitem__, words))
                lengths = np.fromiter(map(len, found), np.int32, len(found))
                ids = np.fromiter((i for f in found for i in f), np.int32, int(lengths.sum()))
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[one.column(c) for c in ("partition", "block", "bucket")],
                        pa.array([pack_numbers(lengths)], pa.binary()),
                        pa.array([pack_numbers(ids)], pa.binary()),
                    ],
                    ["partition", "block", "bucket", "lengths", "tokens"],
                )

    met = packed.where(F.col("bucket") != TEXTS).select("partition", "block", "bucket", "words")
    met = met.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(run, "partition int, block int, bucket int, lengths binary, tokens binary")


def encoded(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """doc_id and ids (32-bit little-endian) of every whole text.

    Documents come back block by block; a block holds some million characters, or one longer text.
    The stored table is cut into blocks twice, once for the words and once for the positions, which
    costs less than keeping both on disk.
    """
    parts = partitions(docs.sparkSession)
    buckets = buckets or 4 * parts
    answers = encoded_words(blocks(docs, _words, buckets, only="words"), path, parts)
    texts = blocks(docs, _words, buckets, only="texts").select("partition", "block", "ids", "sizes", "places")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        id_type = left.schema.field("ids").type.value_type
        out_ids, out_tokens = [], []
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        lengths = [unpack_numbers(right.column("lengths")[k].as_py()) for k in order]
        tokens = [unpack_numbers(right.column("tokens")[k].as_py()) for k in order]
        lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        for k in range(left.num_rows):
            sizes = unpack_numbers(left.column("sizes")[k].as_py())
            places = unpack_numbers(left.column("places")[k].as_py())
            ends = np.cumsum(sizes)
            for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                at = places[a:b]
                out_tokens.append(gathered(tokens, starts[at], lengths[at]).astype("<i4").tobytes())
            out_ids.append(left.column("ids")[k].values)
        ids = pa.concat_arrays(out_ids) if out_ids else pa.array([], id_type)
        return pa.table({"doc_id": ids, "ids": pa.array(out_tokens, pa.binary())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = ("partition", "block")
    return (
        texts.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(run, f"doc_id {id_type}, ids binary")
    )


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of the vocabulary, by id."""
    encoding = rank_encoding(path)
    return [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)]


def decode_ids(blob: bytes, known: list[bytes]) -> bytes:
    """Bytes of 32-bit little-endian ids."""
    return b"".join(map(known.__getitem__, np.frombuffer(blob, "<i4").tolist()))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds `bytes`, the text's bytes, to rows with 32-bit little-endian `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(token_bytes(path))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode_ids(b, shared.value) for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(texts, pa.binary())], [*names, "bytes"]
                )

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, bytes binary")


def op3_word_shuffle_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), rank_path())
    shared = spark.sparkContext.broadcast(token_bytes(rank_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids are decoded and digested in one step, so that texts do not travel between two workers
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, texts = [], [], []
                for ids in part.column("ids").to_pylist():
                    numbers = np.frombuffer(ids, "<i4").tolist()
                    counts.append(len(numbers))
                    digests.append(hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest())
                    texts.append(hashlib.sha256(decode_ids(ids, shared.value)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op3_word_shuffle_bpe": op3_word_shuffle_bpe}
SQL: dict[str, str] = {}
