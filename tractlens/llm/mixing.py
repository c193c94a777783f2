"""Operator 10: language-model scoring by online logistic context mixing.

A text is a row of tokens: its lower-cased words, then one end. A token is spelled byte by byte and
closed by a space (the end token is the bare space), and every bit of every byte is predicted. Six
predictors hold bit counts of the training tokens: the bytes so far of the current symbol after the
last 0 to 4 bytes of the token (hashed contexts), and after the whole beginning of the token. Their
log-odds are mixed by weights that a gate picks from the bit's place and the evidence of the longest
context, trained online, batch after batch; an adaptive probability map refines the result. The
product over a token's bits is its spelling probability.

Two word contexts stand above the spelling: the previous token, and the previous two. After a
context h seen c(h) times, of which c(h, w) times with w next, a token has probability
(c(h, w) + a p(w)) / (c(h) + a), where p is that of the next shorter context and at last the
spelling; so the probabilities of all tokens after any context still add up to one. A text begins
after an end token. The sum of log10 probabilities of the tokens is the score of a text; minus that
times log2(10), over the bytes spelled (tokens with their closing spaces), is its bits per byte.

1. Blocks of documents send their distinct tokens with training counts (`wordblocks`), dealt by the
   first four bytes, so all tokens with a common beginning of four bytes or more meet.
2. Per bucket the tokens are merged; the counts of the hashed contexts, whose tables have a fixed
   size, are summed over all tasks; the counts of whole beginnings never leave their bucket.
3. Each task trains the mixer over its tokens from the same start; weights are averaged by evidence.
   While training, a token's own occurrence is taken out of all counts it meets, so a context seen
   once teaches nothing about itself.
4. Tokens are spelled once each and the answers travel back to their blocks.
5. The texts' places and their words' hashes stay in the stored blocks, so no text is cut twice. Blocks
   send their distinct pairs and triples of neighbouring tokens, as 48 bits of a hash with the
   block's training count, dealt by that hash: a frequent pair is one entry per block and a frequent
   context is spread over all buckets. c(h) needs no rows of its own: it is the count of the shorter
   sequence. The sums travel back and every text is put together in its block.
6. A text is scored for every pair of `CONCENTRATIONS`; the pair under which the training tokens, each
   taken out of its own counts, are likeliest is used for all texts.

Null texts count as empty
(one end token). Rows with a null id train and are scored; repeated rows count as often as they stand
there. Without training tokens every bit has probability one half. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import freed_shuffles, held_out, partitions, settled, table
from tractlens.llm.wordblocks import TEXTS, blocks, pack_numbers, pack_strings, unpack_numbers, unpack_strings

HEAD = 4
ORDERS = 5
SLOT_BITS = 18
CHUNK = 1 << 13
EVIDENCE = 8
GATES = 2 * EVIDENCE * 8
CELLS = 33
REACH = 8.0
PRIOR = 0.4
RATE = 0.15
SLICES = 64
CONCENTRATIONS = (1.0, 8.0, 64.0, 512.0)
KEY_BITS = 48
_CHUNK_BYTES = 16_000
# a factor is 1e-24 at least while a corpus has fewer than 1e12 tokens, so a product of so many is no zero
_FACTORS = 12
_PIECES = 1 << 10
_INPUTS = ORDERS + 2
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), b""]


def head_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Words with the same first bytes share a bucket."""
    return np.fromiter((zlib.crc32(w[:HEAD]) for w in words), np.int64, len(words)) % buckets


class Spelled:
    """The bytes of sorted tokens, each closed by a space, and the counts of their beginnings."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        order = sorted(range(len(words)), key=lambda k: words[k] + b" ")
        self.words = [words[k] for k in order]
        self.order = np.array(order, np.int64)
        self.counts = counts[self.order].astype(np.float64)
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(words)) + 1
        self.ends = np.cumsum(self.lengths)
        self.flat = np.frombuffer(b"".join(w + b" " for w in self.words), np.uint8)
        self._count_beginnings()

    def _count_beginnings(self) -> None:
        """Per byte and bit: training tokens with the same beginning, and those with a one next."""
        starts = self.ends - self.lengths
        # a beginning that no other token has holds the token's own count
        deep = np.arange(len(self.flat)) - np.repeat(starts, self.lengths) >= HEAD
        self.total = np.repeat((np.repeat(self.counts, self.lengths) * deep).astype(np.float32)[:, None], 8, axis=1)
        self.ones = self.total * (self.flat[:, None] >> np.arange(7, -1, -1, dtype=np.uint8) & 1)
        alive = np.arange(len(self.words))
        group = np.zeros(len(alive), np.int64)
        for depth in range(int(self.lengths.max(initial=0))):
            keep = self.lengths[alive] > depth
            alive, group = alive[keep], group[keep]
            if not len(alive):
                break
            at = starts[alive] + depth
            symbol, weight = self.flat[at].astype(np.int64), self.counts[alive]
            if depth >= HEAD:
                for bit in range(8):
                    part = (group << 8) | (symbol >> (8 - bit))
                    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    sizes = np.diff(np.append(first, len(part)))
                    one = weight * ((symbol >> (7 - bit)) & 1)
                    self.total[at, bit] = np.repeat(np.add.reduceat(weight, first), sizes)
                    self.ones[at, bit] = np.repeat(np.add.reduceat(one, first), sizes)
            pair = (group << 8) | symbol
            group = np.cumsum(np.concatenate(([0], (pair[1:] != pair[:-1]).astype(np.int64))))
            shared = np.bincount(group)[group] > 1
            alive, group = alive[shared], group[shared]

    def chunks(self) -> Iterator[np.ndarray]:
        """Token numbers, dealt so that every chunk is a cross-section."""
        count = max(1, -(-len(self.flat) // _CHUNK_BYTES))
        for k in range(min(count, len(self.words))):
            yield np.arange(k, len(self.words), count)

    def bits(self, chosen: np.ndarray) -> dict[str, np.ndarray]:
        """Bits, slots and counts of the chosen tokens, one row per byte and one column per bit."""
        lengths = self.lengths[chosen]
        stops = np.cumsum(lengths)
        depth = np.arange(int(stops[-1])) - np.repeat(stops - lengths, lengths)
        at = np.repeat((self.ends - self.lengths)[chosen], lengths) + depth
        symbol = self.flat[at].astype(np.uint32)
        before = [np.where(depth >= k, self.flat[at - np.minimum(k, depth)], 0).astype(np.uint32) for k in range(1, ORDERS)]
        shifts = np.arange(8, dtype=np.uint32)
        node = (np.uint32(1) << shifts) | (symbol[:, None] >> (np.uint32(8) - shifts))
        slots = np.empty((ORDERS, len(symbol), 8), np.int32)
        context = np.zeros(len(symbol), np.uint32)
        for order in range(ORDERS):
            if order:
                context = (context ^ (before[order - 1] + np.uint32(1))) * _MIX[order]
            if order < 2:
                slots[order] = (before[0][:, None] << np.uint32(8) | node) if order else node
            else:
                mixed = (context[:, None] ^ node * _MIX[0]) * np.uint32(0x9E3779B1)
                slots[order] = (mixed ^ mixed >> np.uint32(15)) * _MIX[1] >> np.uint32(32 - SLOT_BITS)
        return {
            "bit": ((symbol[:, None] >> (np.uint32(7) - shifts)) & 1).astype(np.float32),
            "slots": slots,
            "weight": np.repeat(self.counts[chosen], lengths).astype(np.float32),
            "deep": depth >= HEAD,
            "total": self.total[at],
            "ones": self.ones[at],
            "lengths": lengths,
        }


def slot_odds(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of every slot (order x way x slot) and the evidence of the slots of the last order.

    The ways: all counts, without one zero, without one one.
    """
    zeros, ones = tables
    ways = ((zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0)))
    odds = np.stack([np.log((o + np.float32(PRIOR)) / (z + np.float32(PRIOR))) for z, o in ways], axis=1)
    return odds, ones[-1] + zeros[-1]


def _inputs(events: dict[str, np.ndarray], odds: tuple[np.ndarray, np.ndarray], without_own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of all predictors (predictor x byte x bit) and the gate of every bit."""
    bit = events["bit"]
    own = 1.0 if without_own else 0.0
    x = np.empty((_INPUTS, *bit.shape), np.float32)
    way = (bit.astype(np.int32) << SLOT_BITS) if without_own else None
    for order, slots in enumerate(events["slots"]):
        ways = odds[0][order, 1:] if without_own else odds[0][order, 0]
        # every slot is in range; clipping only spares numpy a copy
        np.take(ways.ravel(), slots + way if without_own else slots, out=x[order], mode="clip")
    evidence = np.take(odds[1], events["slots"][-1], mode="clip") - np.float32(own)
    deep = events["deep"][:, None]
    ones = np.maximum(events["ones"] - own * bit, 0)
    zeros = np.maximum(events["total"] - events["ones"] - own * (1 - bit), 0)
    x[ORDERS] = np.where(deep, np.log((ones + PRIOR) / (zeros + PRIOR)), 0)
    x[ORDERS + 1] = 0.3
    evidence = np.where(deep, ones + zeros, evidence)
    # the exponent of a float is the floor of its logarithm
    exponent = ((np.maximum(evidence, 0) + np.float32(1)).astype(np.float32).view(np.int32) >> 23) - 127
    level = np.minimum(exponent, EVIDENCE - 1)
    gate = (level + EVIDENCE * deep) * 8 + np.arange(8)
    return x, gate


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of the mixture."""
    columns = np.ascontiguousarray(weights.T)
    total = np.take(columns[0], gate, mode="clip") * x[0]
    for k in range(1, _INPUTS):
        total += np.take(columns[k], gate, mode="clip") * x[k]
    return np.clip(total, -12, 12)


def first_weights() -> np.ndarray:
    weights = np.full((GATES, _INPUTS), 0.15, np.float32)
    weights[:, ORDERS - 1 : ORDERS + 1] = 0.4
    weights[:, -1] = 0
    return weights


def _cell(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(logit, -REACH, REACH) + REACH) * ((CELLS - 1) / (2 * REACH))
    low = np.minimum(place.astype(np.int32), CELLS - 2)
    return low, place - low


def refined(logit: np.ndarray, gate: np.ndarray, refinement: np.ndarray) -> np.ndarray:
    """The mixture's log-odds averaged with what the map says they mean."""
    low, share = _cell(logit)
    row = (gate >> 3) * CELLS + low
    flat = refinement.ravel()
    return (logit + (1 - share) * np.take(flat, row, mode="clip") + share * np.take(flat, row + 1, mode="clip")) / 2


def table_chunks(rows: DataFrame) -> DataFrame:
    """Counts of hashed contexts as packed chunks: order, chunk, ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ORDERS, 1 << SLOT_BITS))
        for batch in batches:
            for k in range(batch.num_rows):
                counts = unpack_numbers(batch.column("counts")[k].as_py())
                words = unpack_strings(batch.column("words")[k].as_py())
                seen = [w for w, c in zip(words, counts.tolist()) if c]
                spelled = Spelled(seen, counts[counts > 0])
                for chosen in spelled.chunks():
                    events = spelled.bits(chosen)
                    one = events["weight"][:, None] * events["bit"]
                    zero = events["weight"][:, None] - one
                    for order in range(ORDERS):
                        slots = events["slots"][order].ravel()
                        sums[1, order] += np.bincount(slots, one.ravel(), 1 << SLOT_BITS)
                        sums[0, order] += np.bincount(slots, zero.ravel(), 1 << SLOT_BITS)
        flat = sums.reshape(2 * ORDERS * ((1 << SLOT_BITS) // CHUNK), CHUNK)
        held = np.flatnonzero(flat.any(axis=1))
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([pack_numbers(flat[k]) for k in held], pa.binary())], ["chunk", "counts"]
            )

    return rows.mapInArrow(run, "chunk int, counts binary")


def _summed(group: pa.Table) -> pa.Table:
    total = sum(unpack_numbers(b) for b in group.column("counts").to_pylist())
    return pa.table({"chunk": group.column("chunk").slice(0, 1), "counts": pa.array([pack_numbers(total)], pa.binary())})


def merged_words(packed: DataFrame, parts: int) -> DataFrame:
    """One row per bucket: its distinct tokens and their training counts."""

    def run(group: pa.Table) -> pa.Table:
        totals: dict[bytes, int] = {}
        for words, sizes in zip(group.column("words").to_pylist(), group.column("sizes").to_pylist()):
            for w, c in zip(unpack_strings(words), unpack_numbers(sizes).tolist()):
                totals[w] = totals.get(w, 0) + c
        words = sorted(totals)
        counts = np.fromiter(map(totals.__getitem__, words), np.int64, len(words))
        return pa.table(
            {
                "bucket": group.column("bucket").slice(0, 1),
                "words": pa.array([pack_strings(words)], pa.binary()),
                "counts": pa.array([pack_numbers(counts)], pa.binary()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
                "types": pa.array([int((counts > 0).sum())], pa.int64()),
            }
        )

    rows = packed.where(F.col("bucket") != TEXTS).select("bucket", "words", "sizes").repartition(parts, "bucket")
    return rows.groupBy("bucket").applyInArrow(run, "bucket int, words binary, counts binary, tokens long, types long")


def context_tables(merged: DataFrame) -> np.ndarray:
    """Zeros and ones of every slot (2 x order x slot); their size is fixed whatever the corpus."""
    found = table_chunks(merged)
    # summed in two steps, so that a sum never has more members than the root of the tasks
    found = found.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    found = found.groupBy("chunk", "slice").applyInArrow(_summed, "chunk int, counts binary")
    found = found.groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary")
    flat = np.zeros((2 * ORDERS * ((1 << SLOT_BITS) // CHUNK), CHUNK), np.float32)
    for row in found.collect():
        flat[row["chunk"]] = unpack_numbers(bytes(row["counts"]))
    return flat.reshape(2, ORDERS, 1 << SLOT_BITS)


def trained(merged: DataFrame, odds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights (gate x predictor) and the adaptive map (evidence x cell), as log-odds."""
    shared = merged.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = first_weights()
        mass = np.zeros(GATES)
        seen = np.zeros((2, GATES // 8 * CELLS))
        for batch in batches:
            for k in range(batch.num_rows):
                counts = unpack_numbers(batch.column("counts")[k].as_py())
                words = unpack_strings(batch.column("words")[k].as_py())
                spelled = Spelled([w for w, c in zip(words, counts.tolist()) if c], counts[counts > 0])
                for chosen in spelled.chunks():
                    events = spelled.bits(chosen)
                    x, gate = _inputs(events, shared.value, without_own=True)
                    logit = _mixed(x, gate, weights)
                    p = 1 / (1 + np.exp(-logit))
                    weight = np.broadcast_to(events["weight"][:, None], p.shape).ravel()
                    bit, gates = events["bit"].ravel(), gate.ravel()
                    low, share = _cell(logit)
                    row = ((gate >> 3) * CELLS + low).ravel()
                    for step, part in ((0, 1 - share.ravel()), (1, share.ravel())):
                        seen[0] += np.bincount(row + step, weight * part, seen.shape[1])
                        seen[1] += np.bincount(row + step, weight * part * bit, seen.shape[1])
                    off = weight * (p.ravel() - bit)
                    sure = weight * (p * (1 - p)).ravel()
                    mass += np.bincount(gates, weight, GATES)
                    for k_ in range(_INPUTS):
                        xk = x[k_].ravel()
                        slope = np.bincount(gates, off * xk, GATES)
                        curve = np.bincount(gates, sure * xk * xk, GATES)
                        weights[:, k_] -= np.clip(RATE * slope / (curve + 1.0), -0.1, 0.1)
        out = np.concatenate([(weights * mass[:, None]).ravel(), mass, seen.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(out)), pa.int32()), pa.array(out, pa.float64())], ["place", "value"]
        )

    summed = merged.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(GATES * (_INPUTS + 1) + 2 * (GATES // 8) * CELLS)
    for row in summed.collect():
        out[row["place"]] = row["value"]
    mass = out[GATES * _INPUTS : GATES * (_INPUTS + 1)]
    weights = out[: GATES * _INPUTS].reshape(GATES, _INPUTS)
    weights = np.where(mass[:, None] > 0, weights / np.maximum(mass, 1e-9)[:, None], first_weights())
    seen = out[GATES * (_INPUTS + 1) :].reshape(2, GATES // 8, CELLS)
    # an empty cell maps to itself
    own = np.linspace(-REACH, REACH, CELLS)
    prior = 1 / (1 + np.exp(-own))
    share = (seen[1] + 4 * prior) / (seen[0] + 4)
    return weights.astype(np.float32), np.log(share / (1 - share)).astype(np.float32)


def spelled_log10(
    spelled: Spelled, tables: np.ndarray, weights: np.ndarray, refinement: np.ndarray, without_own: bool = False
) -> np.ndarray:
    """log10 probability of every token, in the order the tokens were given in."""
    return _spelled_log10s(spelled, slot_odds(tables), weights, refinement, [without_own])[0]


def _spelled_log10s(
    spelled: Spelled, odds: tuple[np.ndarray, np.ndarray], weights: np.ndarray, refinement: np.ndarray, own: list[bool]
) -> np.ndarray:
    """One row for each of `own`: whether a token's own occurrence is taken out."""
    result = np.zeros((len(own), len(spelled.words)))
    for chosen in spelled.chunks():
        events = spelled.bits(chosen)
        stops = np.cumsum(events["lengths"])
        for k, without in enumerate(own):
            x, gate = _inputs(events, odds, without_own=without)
            logit = refined(_mixed(x, gate, weights), gate, refinement)
            # log of the probability of the bits that are there, one logarithm for a byte's eight
            odds_against = np.exp(np.where(events["bit"] > 0, -logit, logit))
            cost = np.log((1 + odds_against.astype(np.float64)).prod(axis=1))
            result[k, spelled.order[chosen]] = -np.add.reduceat(cost, stops - events["lengths"]) / np.log(10)
    return result


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), "<u8")


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sequence_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (previous, token) and of (the two previous, token) at every place of the texts.

    The first token of a text has no triple; its place repeats the key of its pair.
    """
    first = np.zeros(len(hashes), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.where(first, word_hashes([b""])[0], np.roll(hashes, 1))
    two = _stirred(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
    three = _stirred(np.roll(two, 1) * np.uint64(0xD6E8FEB86659FD93) + hashes)
    shift = np.uint64(64 - KEY_BITS)
    return two >> shift, np.where(first, two, three) >> shift


def sequences(docs: DataFrame, buckets: int, train: str) -> DataFrame:
    """Distinct pairs and triples of every block of `blocks`, sorted, with their training counts."""
    return block_sequences(blocks(docs, tokens_of, buckets, head_buckets, train, only="texts", mark=word_hashes), buckets)


def block_sequences(packed: DataFrame, buckets: int) -> DataFrame:
    """The same from the packed texts of `blocks`, whose words are marked with their hashes.

    Buckets are ranges of keys and are numbered -2, -3 and so on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, places, flags = (unpack_numbers(batch.column(c)[row].as_py()) for c in ("sizes", "places", "flags"))
                hashes = unpack_numbers(batch.column("marks")[row].as_py())
                two, three = sequence_keys(hashes[places], sizes)
                longer = np.ones(len(two), bool)
                longer[np.cumsum(sizes) - sizes] = False
                weight = np.repeat(flags != 0, sizes)
                # the training mark rides behind the key, so that one plain sort brings equal keys together
                marked = np.concatenate((two << np.uint64(1) | weight, three << np.uint64(1) | weight & longer))
                marked.sort()
                keys = marked >> np.uint64(1)
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys = keys[first]
                counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
                which = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
                begins = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                ends = np.append(begins[1:], len(keys))
                rows = range(len(begins))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("partition")[row].as_py()] * len(rows), pa.int32()),
                        pa.array([batch.column("block")[row].as_py()] * len(rows), pa.int32()),
                        pa.array(-2 - which[begins].astype(np.int64), pa.int32()),
                        # the low bytes of a hash's steps hold nothing to compress
                        pa.array([pack_numbers(_steps(keys[begins[k] : ends[k]]), plain=3) for k in rows], pa.binary()),
                        pa.array([pack_numbers(counts[begins[k] : ends[k]]) for k in rows], pa.binary()),
                    ],
                    ["partition", "block", "bucket", "keys", "sizes"],
                )

    return _texts(packed, "sizes", "places", "marks").mapInArrow(run, "partition int, block int, bucket int, keys binary, sizes binary")


def _texts(packed: DataFrame, *columns: str) -> DataFrame:
    return packed.where(F.col("bucket") == TEXTS).select("partition", "block", F.col("words").alias("flags"), *columns)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, in four bytes where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps if len(steps) and steps.max() >> np.uint64(32) else steps.astype(np.uint32)


def summed_sequences(group: pa.Table) -> pa.Table:
    """Corpus counts of the keys of one bucket, for every block that asked."""
    asked = [np.cumsum(unpack_numbers(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    counts = np.concatenate([unpack_numbers(c) for c in group.column("sizes").to_pylist()])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(at, counts, len(keys)).astype(np.int64)[at]
    return pa.table(
        {
            "partition": group.column("partition"),
            "block": group.column("block"),
            "bucket": group.column("bucket"),
            "counts": pa.array([pack_numbers(t) for t in np.split(totals, np.cumsum([len(a) for a in asked])[:-1])], pa.binary()),
        }
    )


def in_context(
    logs: np.ndarray, pair: np.ndarray, one: np.ndarray, triple: np.ndarray, two: np.ndarray, begins: np.ndarray
) -> np.ndarray:
    """Sums of the log10 probabilities in context over runs of tokens: a row per pair of concentrations.

    `logs` are the spellings'; `pair` and `triple` count the sequences that end in the token, `one`
    and `two` their contexts. A run goes from one of `begins` to the next.
    """
    met = pair > 0
    # a long new word's spelling may be too small for a float, so a new token's spelling is added as a logarithm
    p0 = np.where(met, 10.0**logs, 1.0)
    sums = np.tile(np.add.reduceat(np.where(met, 0, logs), begins), (len(CONCENTRATIONS) ** 2, 1))
    sizes = np.diff(begins, append=len(logs))
    pieces = -(-sizes // _FACTORS)
    ends = np.cumsum(pieces)
    starts = np.repeat(begins, pieces) + (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)) * _FACTORS
    found = np.empty((len(sums), len(starts)))
    # some texts' worth of pieces at a time stays in the processor's cache
    for at in range(0, len(starts), _PIECES):
        here = starts[at : at + _PIECES]
        part = slice(here[0], starts[at + _PIECES] if at + _PIECES < len(starts) else len(logs))
        known, spelling, longer, cut = pair[part], p0[part], triple[part], here - here[0]
        share = [1 / (two[part] + b) for b in CONCENTRATIONS]
        k = 0
        for a in CONCENTRATIONS:
            p1 = (known + a * spelling) / (one[part] + a)
            for b, each in zip(CONCENTRATIONS, share):
                # fewer logarithms: one for the product of a few tokens
                found[k, at : at + len(here)] = np.multiply.reduceat((longer + b * p1) * each, cut)
                k += 1
    return sums + np.add.reduceat(np.log10(found), ends - pieces, axis=1)


def scored(docs: DataFrame, train: str = "train") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte of every text.

    `train` is 0 or 1.
    """
    spark = docs.sparkSession
    with freed_shuffles(spark):
        return _scored(docs, train)


def _scored(docs: DataFrame, train: str) -> DataFrame:
    spark = docs.sparkSession
    parts = partitions(spark)
    # the texts are cut into tokens once; whatever follows reads places and hashes
    packed = settled(blocks(docs, tokens_of, 4 * parts, head_buckets, train, mark=word_hashes))
    # a step of its own, so the largest shuffle is gone before the answers travel
    found = block_sequences(packed, parts).repartition(parts, "bucket").groupBy("bucket")
    found = settled(found.applyInArrow(summed_sequences, "partition int, block int, bucket int, counts binary"))
    merged = settled(merged_words(packed, parts))
    sizes = merged.agg(F.sum("tokens"), F.sum("types")).first()
    seen, types = int(sizes[0] or 0), int(sizes[1] or 0)
    # rows are bucket-wide already; they are dealt evenly before each pass over them
    dealt = merged.repartition(parts, "bucket")
    odds = slot_odds(context_tables(dealt))
    weights, refinement = trained(dealt, odds)
    shared = spark.sparkContext.broadcast((odds, weights, refinement))

    def score_bucket(group: pa.Table) -> pa.Table:
        lists = [unpack_strings(w) for w in group.column("words").to_pylist()]
        totals: dict[bytes, int] = {}
        for words, sizes in zip(lists, group.column("sizes").to_pylist()):
            for w, c in zip(words, unpack_numbers(sizes).tolist()):
                totals[w] = totals.get(w, 0) + c
        words = list(totals)
        counts = np.fromiter(totals.values(), np.int64, len(words))
        number = dict(zip(words, range(len(words))))
        logs, own = _spelled_log10s(Spelled(words, counts), *shared.value, [False, True]).astype(np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = [np.fromiter(map(number.__getitem__, one), np.int64, len(one)) for one in lists]
        return pa.table(
            {
                "partition": group.column("partition"),
                "block": group.column("block"),
                "bucket": group.column("bucket"),
                "counts": pa.array([pack_numbers(counts[k]) for k in at], pa.binary()),
                "logs": pa.array([pack_numbers(logs[k], plain=2) for k in at], pa.binary()),
                "own_logs": pa.array([pack_numbers(own[k], plain=2) for k in at], pa.binary()),
                "lengths": pa.array([pack_numbers(lengths[k]) for k in at], pa.binary()),
            }
        )

    words = packed.where(F.col("bucket") != TEXTS).select("partition", "block", "bucket", "words", "sizes")
    answer = "partition int, block int, bucket int, counts binary, logs binary, own_logs binary, lengths binary"
    answers = words.repartition(parts, "bucket").groupBy("bucket").applyInArrow(score_bucket, answer)
    texts = _texts(packed, "ids", "sizes", "places", "marks")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = right.column("bucket").to_numpy()

        def joined(name: str, rows: np.ndarray) -> np.ndarray:
            return np.concatenate([unpack_numbers(right.column(name)[k].as_py()) for k in rows.tolist()])

        order = np.argsort(bucket, kind="stable")
        order = order[bucket[order] >= 0]
        counts, logs, own_logs, lengths = (joined(c, order) for c in ("counts", "logs", "own_logs", "lengths"))
        base = np.log10((counts + 1) / (seen + types + 1))
        # ranges of keys are numbered downwards
        order = np.argsort(-bucket, kind="stable")
        answered = joined("counts", order[bucket[order] < 0])
        sizes, places, flags, hashes = (unpack_numbers(left.column(c)[0].as_py()) for c in ("sizes", "places", "flags", "marks"))
        # every text has its end token, so no run is empty
        begins = np.cumsum(sizes) - sizes
        pairs, triples = sequence_keys(hashes[places], sizes)
        at = np.unique(np.concatenate((pairs, triples)), return_inverse=True)[1]
        pair, triple = answered[at[: len(pairs)]].astype(np.float64), answered[at[len(pairs) :]].astype(np.float64)
        one, two = np.roll(counts[places], 1).astype(np.float64), np.roll(pair, 1)
        # a text begins after an end token, and its first token has no context of two
        one[0] = counts[places[-1]]
        triple[begins], two[begins] = 0, 0
        scores = in_context(logs[places].astype(np.float64), pair, one, triple, two, begins)
        fits = np.zeros(len(scores))
        learnt = np.repeat(flags != 0, sizes)
        if learnt.any():
            ones = (pair - 1, one - 1, np.maximum(triple - 1, 0), np.maximum(two - 1, 0))
            left_out = own_logs[places].astype(np.float64), *ones
            fits = in_context(*(v[learnt] for v in left_out), np.zeros(1, np.int64))[:, 0]
        sums = [np.add.reduceat(v[places], begins) for v in ((counts > 0).astype(np.int64), lengths, base)]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.T.ravel()), len(scores)).cast(pa.list_(pa.float64()))
        return pa.table(
            {
                "doc_id": left.column("ids").chunk(0).flatten(),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(sums[0], pa.int64()),
                "n_bytes": pa.array(sums[1], pa.int64()),
                "base_score": pa.array(sums[2], pa.float64()),
                "scores": lists,
                # only their sum is asked for: the block's first row holds it
                "fits": pa.array([fits.tolist(), *[None] * (len(sizes) - 1)], pa.list_(pa.float64())),
            }
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = ("partition", "block")
    fields = f"doc_id {id_type}, n_tokens long, n_known long, n_bytes long, base_score double, scores array<double>, fits array<double>"
    result = settled(texts.groupBy(*keys).cogroup(answers.unionByName(found, allowMissingColumns=True).groupBy(*keys)).applyInArrow(add_up, fields))
    total = result.agg(*[F.sum(F.col("fits")[k]) for k in range(len(CONCENTRATIONS) ** 2)]).first()
    best = int(np.argmax([t or 0 for t in total]))
    return result.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(seen).cast("long").alias("train_tokens"),
        "n_bytes",
        "base_score",
        F.col("scores")[best].alias("score"),
        (F.col("scores")[best] * -float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", (~held_out(2, 7)).cast("long").alias("train"))
    return scored(docs).select(
        "doc_id",
        held_out(2, 7).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "n_bytes",
        "bits_per_byte",
    )


QUERIES = {"op10_context_mixing": op10_context_mixing}
SQL: dict[str, str] = {}
