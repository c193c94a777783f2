"""The global distinct-word shuffle that operators 3 and 10 share.

A task cuts its documents into blocks and every text into words. Inside a block a word is sent once,
whatever its count, beside nothing but its place in the block's word list; the texts stay behind as
lists of such places. So the most frequent word of the corpus costs one entry per block and no key is
hot. Words meet by bucket (a hash), are computed once each, and the answers go back to their block,
where the texts are put together again by position.

A block's words of one bucket travel as one packed row, sorted, which keeps the shuffle a fraction of
the text. Rows of a block are told apart by (partition, number), so the input must be a stored table:
a task that is run again then cuts the same blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_CHARS = 4 << 20
TEXTS = -1
"""The bucket number of the rows that hold a block's texts."""


def pack_strings(strings: list[bytes]) -> bytes:
    """Lengths and bytes of the strings, compressed."""
    lengths = np.fromiter(map(len, strings), "<u4", len(strings))
    return zlib.compress(np.uint32(len(strings)).tobytes() + lengths.tobytes() + b"".join(strings), 1)


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = zlib.decompress(blob)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64) + 4 + 4 * count
    starts = np.concatenate(([4 + 4 * count], ends[:-1])).tolist() if count else []
    return [raw[a:b] for a, b in zip(starts, ends.tolist())]


def pack_numbers(numbers: np.ndarray, plain: int = 0) -> bytes:
    """Integers or floats, byte planes apart, compressed.

    The lowest `plain` planes are kept as they are: those of hashes and fractions do not compress.
    """
    wide = numbers.astype(numbers.dtype.newbyteorder("<"))
    planes = np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), wide.dtype.itemsize).T
    head = wide.dtype.char.encode()
    if not plain:
        return head + zlib.compress(planes.tobytes(), 1)
    low = np.uint32(planes[:plain].size).tobytes()
    return b"=" + head + low + planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def unpack_numbers(blob: bytes) -> np.ndarray:
    if blob[:1] == b"=":
        kind, low = np.dtype(blob[1:2].decode()), 6 + int(np.frombuffer(blob, "<u4", 1, 2)[0])
        raw = blob[6:low] + zlib.decompress(blob[low:])
    else:
        kind, raw = np.dtype(blob[:1].decode()), zlib.decompress(blob[1:])
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def hash_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def blocks(
    docs: DataFrame,
    split: Callable[[str], list],
    buckets: int,
    deal: Callable[[list[bytes], int], np.ndarray] = hash_buckets,
    extra: str | None = None,
    only: str | None = None,
    mark: Callable[[list[bytes]], np.ndarray] | None = None,
) -> DataFrame:
    """The packed rows of all documents: partition, block, bucket, words, and for texts ids and places.

    `split` gives the words of a text as bytes. Rows of words hold the words of one bucket, sorted
    as in the block's list, which is ordered by (bucket, word). The row of texts holds the
    document ids, the numbers of words and, one after the other, the words' places in that list.
    `extra` names an integer column of the documents; words get the number of their
    occurrences in documents where it is not zero, and the row of texts holds its values instead of
    words. `only` asks for the rows of "words" or of "texts"
    alone; two such calls over one stored table cut the same blocks. `mark` gives a number for every
    word; the row of texts then holds those of its list as `marks`.
    """
    columns = ["doc_id", "text", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        number = 0
        for held in gathered_rows(batches):
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            flags = np.concatenate([b.column(extra).to_numpy() for b in held]) if extra else np.ones(len(ids), np.int64)
            known: dict[bytes, int] = {}
            sequences, sizes = [], []
            for b in held:
                for text in b.column("text").to_pylist():
                    words = split(text or "")
                    for w in set(words).difference(known):
                        known[w] = len(known)
                    sequences.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    sizes.append(len(words))
            words = list(known)
            which = deal(words, buckets)
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(which[order], kind="stable")]
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            flat = place[np.concatenate(sequences)] if sequences else np.zeros(0, np.int32)
            sizes = np.array(sizes, np.int64)
            if only != "words":
                texts = _row(partition, number, TEXTS)
                texts |= {"ids": ids, "sizes": pack_numbers(sizes), "places": pack_numbers(flat)}
                if extra:
                    texts["words"] = pack_numbers(flags.astype(np.int64))
                if mark:
                    texts["marks"] = pack_numbers(mark([words[k] for k in order]), plain=8)
                yield _batch([texts], ids.type)
            number += 1
            if only == "texts":
                continue
            counted = flat[np.repeat(flags != 0, sizes)]
            counts = np.bincount(counted, minlength=len(words)).astype(np.int64)
            rows = []
            ordered, at = which[order], 0
            while at < len(order):
                end = int(np.searchsorted(ordered, ordered[at], side="right"))
                rows.append(
                    _row(partition, number - 1, int(ordered[at]))
                    | {"words": pack_strings([words[k] for k in order[at:end]]), "sizes": pack_numbers(counts[at:end])}
                )
                at = end
            if rows:
                yield _batch(rows, ids.type)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*columns).mapInArrow(
        run,
        f"partition int, block int, bucket int, words binary, ids array<{id_type}>, sizes binary, places binary, marks binary",
    )


def _row(partition: int, block: int, bucket: int) -> dict:
    return dict.fromkeys(("words", "ids", "places", "sizes", "marks")) | {"partition": partition, "block": block, "bucket": bucket}


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    def lists(values):
        whole = [v if v is not None else pa.array([], id_type) for v in values]
        ends = np.concatenate(([0], np.cumsum([len(v) for v in whole])))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(whole))

    number = {c: pa.array([r[c] for r in rows], pa.int32()) for c in ("partition", "block", "bucket")}
    blob = {c: pa.array([r[c] for r in rows], pa.binary()) for c in ("words", "sizes", "places", "marks")}
    names = ["partition", "block", "bucket", "words", "ids", "sizes", "places", "marks"]
    arrays = number | blob | {"ids": lists([r["ids"] for r in rows])}
    return pa.RecordBatch.from_arrays([arrays[n] for n in names], names)


def gathered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring rows of about BLOCK_CHARS bytes; a longer text is a block of its own."""
    held, total = [], 0
    for batch in batches:
        start = 0
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, size in enumerate(sizes):
            if total and total + size > BLOCK_CHARS:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held
                held, total, start = [], 0, i
            total += size
        if len(sizes) > start:
            held.append(batch.slice(start))
    if held:
        yield held
