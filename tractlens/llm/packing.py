"""Operator 1: packs documents into fixed-length sequences along a space-filling curve.

Every document becomes a hashed token vector, its projection on a few directions a cell, its cell a
position on a Hilbert curve. Documents in curve order form one stream of tokens, and the stream is
cut every `length` tokens, so neighbours on the curve share sequences and only the very last
sequence is padded.

A null text counts as empty (its only token is the end token). Repeated rows and rows with a null
id are packed like any other; ties on the curve are ordered by row. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import process_cache, settled, table, text_groups
from tractlens.llm.hilbert import hilbert_keys
from tractlens.operators.scale import running_totals

LENGTH = 2048
END_ID = 1
BUCKETS = 1024
DIMS = 4
BITS = 12
_GROUP_CHARS = 1 << 20


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# fixed value: the pattern of byte-level pre-tokenizers that use their own expression
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(path: str):
    """The vocabulary as a table of merge ranks, where its ids follow its merges; else None.

    Ids are then the same as those of the tokenizers library, at a fraction of its time.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = model["type"] == "BPE" and not told.get("normalizer") and not any(
        model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    if not plain or any(split.get(k) != v for k, v in byte_level.items()):
        return None
    vocabulary, letters = model["vocab"], _byte_letters()
    for i, merge in enumerate(model["merges"]):
        if vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] != 256 + i:
            return None
    special = {t["content"] for t in told.get("added_tokens", [])}
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding(path, pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


def _encoder(path: str):
    """The function from a text to its ids, and the number of ids, once per worker."""
    cache = process_cache()
    if ("tokenizers", path) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        encode = _ranked(path) or (lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        cache["tokenizers", path] = encode, tokenizer.get_vocab_size()
    return cache["tokenizers", path]


def _hash_features(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of every id, and the projection of the buckets."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return bucket, sign, np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


def curve_keys(ids: np.ndarray, document: np.ndarray, count: int, features) -> np.ndarray:
    """Curve positions of `count` documents from their concatenated ids."""
    bucket, sign, projection = features
    vectors = np.bincount(document * BUCKETS + bucket[ids], sign[ids], count * BUCKETS).reshape(count, BUCKETS)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = (vectors / np.where(norms == 0, 1, norms)) @ projection
    cells = np.floor((1 / (1 + np.exp(-1.7 * points))) * (1 << BITS)).clip(0, (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, n, key and the ids (little-endian, 16 bits where the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = _encoder(path)
        size = max(size, end_id + 1)
        features = _hash_features(size)
        width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in text_groups([len(t) for t in texts], _GROUP_CHARS):
                lists = [encode(t) for t in texts[part]]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = np.concatenate(lists).astype(np.int64)
                keys = curve_keys(ids, np.repeat(np.arange(len(lists)), lengths), len(lists), features)
                blobs = [np.append(one, end_id).astype(width).tobytes() for one in lists]
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("row"), pa.array(lengths + 1), pa.array(keys), pa.array(blobs, pa.binary())],
                    ["doc_id", "row", "n", "key", "ids"],
                )

    wide = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    id_type = wide.schema["doc_id"].dataType.simpleString()
    return wide.mapInArrow(run, f"doc_id {id_type}, row long, n long, key long, ids binary")


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their place in a sequence and their ids.

    The token table is written once; only (row, key, n) is sorted along the curve. Running totals
    over range partitions give every document its place in the stream, and the document then knows
    its own cuts.
    """
    tokens = settled(tokenised(docs, path, end_id))
    light = tokens.select("row", "key", F.col("n").alias("_n"))
    placed = running_totals(light, [], [F.col("key"), F.col("row")], {"stop": F.col("_n")})
    placed = placed.select("row", (F.col("stop") - F.col("_n")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            begin = batch.column("begin").to_numpy()
            if not len(n):
                continue
            first = begin // length
            pieces = (begin + n - 1) // length - first + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            sequence = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * length - begin[owner], 0)
            stop = np.minimum((sequence + 1) * length - begin[owner], n[owner])
            blobs = batch.column("ids").to_pylist()
            wide = [len(b) // int(k) for b, k in zip(blobs, n)]
            cut = [
                np.frombuffer(blobs[o], f"<u{wide[o]}", int(b - a), int(a) * wide[o]).astype("<u4").tobytes()
                for o, a, b in zip(owner, start, stop)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(start),
                    pa.array(stop - start),
                    pa.array(n[owner]),
                    pa.array(sequence),
                    pa.array(begin[owner] + start - sequence * length),
                    pa.array(cut, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.drop("key").join(placed, "row").mapInArrow(
        run,
        f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: at most `length` ids each, padded to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts])
                rows.append(np.pad(ids, (0, max(0, length - len(ids))), constant_values=pad_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "ids"]
            )

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    return pieces.groupBy("sequence_id").agg(parts).mapInArrow(run, "sequence_id long, ids array<int>")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"), byte_bpe_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(b) for b in batch.column("ids").to_pylist()], pa.int64())
            kept = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], sums], [*kept, "ids_crc32"])

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(
        run,
        f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long",
    )


QUERIES = {"op1_hilbert_packing": op1_hilbert_packing}
SQL: dict[str, str] = {}
