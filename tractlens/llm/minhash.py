"""Operator 6: near-duplicates by b-bit MinHash.

A document's set is its distinct five-word shingles. The lowest value of each of 128 hash functions
over the set is kept for a moment: bands of four minima give bucket keys, and the lowest bits of all
minima are packed into a signature. Documents that share a bucket are candidates; the share of equal
signature entries, corrected for entries that agree by chance, estimates their similarity and drops
the hopeless ones; the rest are confirmed on their full sets. Links are joined to components.

Nothing emits all pairs of a group:

* documents with the same set are one class, which its smallest id stands for;
* in a first round every class of a bucket is compared with the smallest class of the bucket only;
* later rounds look only at buckets that still hold several components and compare only pairs from
  different components, block against block, by counting signature bits inside the task; sets of
  at most 256 shingles travel along in 16 bits each and are counted there too, so documents that
  only share a frequent passage leave no pair. The second
  round sends the most alike pairs that would join a block's components to the exact test, the third
  round every pair that is left. No bucket is capped.

A pair at the threshold of 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6; the
estimate drops such a pair with a probability of about 1e-6 (its margin is five deviations).

Null and empty texts have an empty set and are linked with nothing. A row with a null id cannot be
named by others: it is kept, its component is null and it takes no part in links. Repeated rows are
copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import partitions, settled, table
from tractlens.llm.components import components

WORDS = 5
THRESHOLD = 75
HASHES = 128
BAND_ROWS = 4
BITS = 4
BLOCK = 512
PAIRS = 100_000
"""Pairs that a task compares in one step."""
MARGIN = 5.0
SMALL = 256
"""Shingles of a set that travels whole to the block comparison, in 16 bits each."""

_RANDOM = np.random.default_rng(20240)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base)
    powers[0] = 1
    return np.multiply.accumulate(powers, out=powers)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z count as lower case.

    A shingle's hash is that of its words with one space between them, taken from prefix sums over
    the bytes of the whole text, so no shingle is ever built as a string.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        words = len(parts)
    joined = np.frombuffer(b" ".join(parts), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), out=sums[1:])
    count = len(parts) - words + 1
    first, last = starts[:count], ends[words - 1 :]
    # the inverse power frees a span of its place in the text
    spans = (sums[last] - sums[first]) * _powers(_INVERSE, len(joined))[first]
    return np.unique(_mixed(spans ^ (np.uint64(0x9E3779B97F4A7C15) * (last - first).astype(np.uint64))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The lowest value of each hash function over a set that is not empty."""
    lowest = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        for k in range(0, HASHES, 32):
            values = part * _FACTORS[k : k + 32] + _OFFSETS[k : k + 32]
            np.minimum(lowest[k : k + 32], values.min(axis=0), out=lowest[k : k + 32])
    return lowest


def signature(lowest: np.ndarray) -> bytes:
    """The lowest BITS bits of every minimum, packed."""
    # the lowest bits of a product depend on few bits of its factors, so minima are mixed first
    low = (_mixed(lowest) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def small_set(shingles: np.ndarray) -> bytes | None:
    """The low 16 bits of every shingle, sorted, of a set of at most SMALL; None for a larger one."""
    if len(shingles) > SMALL:
        return None
    return np.sort((shingles & np.uint64(0xFFFF)).astype("<u2")).tobytes()


def may_reach(small: list[bytes | None], left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of rows can have sets of the threshold; true wherever a set is not small.

    Sets are compared as multisets of short values, which never have fewer members in common than
    the sets themselves, so no pair at the threshold is turned down.
    """
    reach = np.ones(len(left), bool)
    sizes = np.array([-1 if x is None else len(x) // 2 for x in small], np.int64)
    both = np.flatnonzero((sizes[left] >= 0) & (sizes[right] >= 0))
    if not len(both):
        return reach
    used, place = np.unique(np.concatenate([left[both], right[both]]), return_inverse=True)
    width = int(sizes[used].max())
    # what pads a row on the left differs from what pads one on the right
    rows = np.tile(np.arange(1 << 28, (1 << 28) + width, dtype=np.int32), (len(used), 1))
    for k, row in enumerate(used):
        values = np.frombuffer(small[row], "<u2").astype(np.int32)
        # the second of equal values counts as another value
        again = np.arange(len(values)) - np.searchsorted(values, values)
        rows[k, : len(values)] = values | (again.astype(np.int32) << 16)
    a, b = place[: len(both)], place[len(both) :]
    for at in range(0, len(both), 1000):
        part = slice(at, at + 1000)
        other = rows[b[part]]
        met = np.concatenate([rows[a[part]], other + (other >= 1 << 28) * np.int32(1 << 28)], axis=1)
        met.sort(axis=1)
        shared = (met[:, 1:] == met[:, :-1]).sum(axis=1)
        union = sizes[left[both[part]]] + sizes[right[both[part]]] - shared
        reach[both[part]] = 100 * shared >= threshold * union
    return reach


def band_keys(lowest: np.ndarray) -> np.ndarray:
    rows = lowest.reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        key = _mixed(key ^ rows[:, k]) + np.uint64(k)
    return key.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (n x bytes), corrected for agreement by chance."""
    apart = a ^ b
    equal = ((apart & 15) == 0).sum(-1, dtype=np.int32) + ((apart >> 4) == 0).sum(-1, dtype=np.int32)
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def lowest_estimate(threshold: float) -> float:
    """What an estimate at the threshold undercuts by MARGIN deviations."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    return threshold - MARGIN * float(np.sqrt(agree * (1 - agree) / HASHES)) / (1 - chance)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_key (a digest of the whole set), signature, band keys and small set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t) for t in part.column("text").to_pylist()]
                lowest = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([None if m is None else signature(m) for m in lowest], pa.binary()),
                        pa.array([[] if m is None else band_keys(m) for m in lowest], pa.list_(pa.int64())),
                        pa.array([small_set(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "set_key", "signature", "bands", "small"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n long, set_key binary, signature binary, bands array<long>, small binary"
    )


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and full set of the wanted ids; an id that is repeated with other texts has several."""
    # the merge hint keeps the plan the same at every size
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"]
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(sets, f"doc_id {id_type}, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb"))
    shared = F.size(F.array_intersect("_sa", "_sb"))
    both = F.size("_sa") + F.size("_sb") - shared
    return (
        pairs.join(left.hint("merge"), "a")
        .join(right.hint("merge"), "b")
        .where((100 * shared >= threshold * both) & (both > 0))
        .select("a", "b")
        .distinct()
    )


def _star_pairs(buckets: DataFrame, threshold: int) -> DataFrame:
    """Every member of a bucket beside the smallest one, where the estimate allows a link."""
    first = buckets.groupBy("bucket").agg(F.min(F.struct("id", "signature")).alias("first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("bucket", "first")
    met = buckets.join(first, "bucket").where(F.col("id") > F.col("first.id"))
    pairs = met.select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.signature").alias("sa"), F.col("signature").alias("sb"))
    return _promising(pairs.dropDuplicates(["a", "b"]), threshold)


def _promising(pairs: DataFrame, threshold: int) -> DataFrame:
    floor = lowest_estimate(threshold / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("sa", "sb")
            ]
            good = pa.array(estimated(*sides) >= floor)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"]
            )

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def _forest(a: np.ndarray, b: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Places of the strongest pairs that join different components: at most one fewer than these."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for k in np.argsort(-strength, kind="stable").tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            root[x] = y
            chosen.append(k)
    return np.array(chosen, np.int64)


def _cross_pairs(mixed: DataFrame, parts: int, forest: bool, threshold: int) -> DataFrame:
    """Promising pairs of different components inside a bucket, block against block.

    A bucket of m members has ceil(m / BLOCK) blocks; a member travels once per block, and a task
    sees two blocks at a time. With `forest` a block gives only the most alike pairs that would
    join all its components.
    """
    order = ["bucket", "low", "high", "own", "id"]
    sizes = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        mixed.join(sizes, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select(*order, "component", "signature", "bands", "small")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            starts = _starts(rows, order[:3])
            # the last block pair may go on in the next batch
            if len(starts) > 1:
                yield _block_pairs(rows.slice(0, starts[-1]), starts[:-1], forest, threshold)
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield _block_pairs(rest, np.zeros(1, np.int64), forest, threshold)

    kind = mixed.schema["id"].dataType.simpleString()
    sorted_blocks = dealt.repartition(parts, *order[:3]).sortWithinPartitions(*order)
    return sorted_blocks.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a new key begins in sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _block_pairs(rows: pa.Table, starts: np.ndarray, forest: bool, threshold: int) -> pa.RecordBatch:
    """Promising pairs (a, b) of the block pairs that begin at `starts`; rows are sorted by block."""
    count = rows.num_rows
    ids, component, own, low, high, bucket = (
        rows.column(c).to_numpy() for c in ("id", "component", "own", "low", "high", "bucket")
    )
    marks = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(count, -1)
    keys = np.concatenate([c.flatten().to_numpy() for c in rows.column("bands").chunks]).reshape(count, -1)
    band = (keys[starts] == bucket[starts, None]).argmax(axis=1)
    ends = np.append(starts[1:], count)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    # a row meets the rows behind it in its block, or those of the other block
    other = starts + np.add.reduceat((own == low).astype(np.int64), starts)
    first = np.where(low == high, np.arange(count) + 1, other[group])
    partners = np.where(own == low, ends[group] - first, 0)
    total = np.concatenate(([0], np.cumsum(partners)))
    small = rows.column("small").to_pylist()
    floor, found, at = lowest_estimate(threshold / 100), [], 0
    while at < count:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), partners[at:stop])
        right = np.repeat(first[at:stop] - total[at:stop], partners[at:stop]) + np.arange(total[at], total[stop])
        apart = component[left] != component[right]
        left, right = left[apart], right[apart]
        # a pair counts in the first band that it shares, so it leaves once, not once a bucket
        leads = (keys[left] == keys[right]).argmax(axis=1) == band[group[left]]
        left, right = left[leads], right[leads]
        alike = estimated(marks[left], marks[right])
        good = np.flatnonzero(alike >= floor)
        good = good[may_reach(small, left[good], right[good], threshold)]
        found.append((left[good], right[good], alike[good]))
        at = stop
    a, b, strength = (np.concatenate(x) for x in zip(*found))
    if forest and len(a):
        names, number = np.unique(component, return_inverse=True)
        node = group * len(names) + number
        kept = _forest(node[a], node[b], strength)
        a, b = a[kept], b[kept]
    kind = rows.schema.field("id").type
    ends = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    return pa.RecordBatch.from_arrays([pa.array(e, kind) for e in ends], ["a", "b"])


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = settled(signed(docs))
    named = rows.where("doc_id IS NOT NULL AND n > 0")
    # documents with equal sets have equal signatures, so any of them serves
    classes = settled(
        named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("small").alias("small"))
    )
    spread = classes.select("id", "signature", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    buckets = settled(spread.join(crowded, "bucket").select("bucket", "id", "signature"))
    sets = settled(_sets(docs, buckets.select(F.col("id").alias("doc_id")).distinct()))
    links = settled(_confirmed(settled(_star_pairs(buckets, threshold)), sets, threshold))
    parts = partitions(docs.sparkSession)
    for forest in (True, False):
        groups = components(links).withColumnRenamed("node", "id")
        labelled = settled(buckets.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")))
        several = labelled.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        mixed = labelled.join(several.where("_lo < _hi").select("bucket"), "bucket")
        # an id alone may name several sets; with the signature it names their bands
        mixed = mixed.select("bucket", "id", "component", "signature").join(
            classes.select("id", "signature", "bands", "small").dropDuplicates(["id", "signature"]), ["id", "signature"]
        )
        crossing = settled(_cross_pairs(mixed, parts, forest, threshold))
        links = settled(links.union(_confirmed(crossing, sets, threshold)))
    final = components(links)
    of_class = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("_component")
    )
    joined = rows.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("_component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the smallest id.

    An id names one document: of rows that repeat it one stays. Rows with a null id all stay.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    unnamed = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    left = docs.withColumn("_unnamed", unnamed).join(gone, "doc_id", "left_anti")
    return left.dropDuplicates(["doc_id", "_unnamed"]).select(*docs.columns)


QUERIES = {"op6_bbit_minhash": op6_bbit_minhash}
SQL: dict[str, str] = {}
