"""Operator 5: reshards a stored table with the fewest moved bytes.

Rows lie in old shards. Every old shard is cut into blocks by a hash of the row's id, and block
sizes are summed by Spark; their number is bounded by `blocks`, whatever the table holds. From old
shard sizes and new capacities a minimum-cost flow says how many bytes go from where to where
(staying costs nothing, moving a byte costs one), blocks are dealt to meet the flow, and only the
files of shards whose blocks change are written again.

Sizes count the text's UTF-8 bytes plus 16; a null text has none. Rows with a null id and repeated
rows are placed like any other; several copies of one row may share a block. An empty table gives
no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.llm.common import partitions, settled, table
from tractlens.session import scratch_folder

SHARDS = 40
OLD_SHARDS = 32
BLOCKS = 8192
OVERHEAD = 16


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "text_crc32": crc})


def with_blocks(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds `block`: each old shard gets a number of blocks in proportion to its bytes."""
    shares = rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()
    total = sum(r["bytes"] for r in shares) or 1
    count = {r["old_shard"]: max(1, round(blocks * r["bytes"] / total)) for r in shares}
    per_shard = F.create_map(*[F.lit(x) for pair in count.items() for x in pair]) if count else F.create_map(F.lit(0), F.lit(1))
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), "text_crc32")))
    return rows.withColumn("block", F.pmod(spread, F.try_element_at(per_shard, F.col("old_shard")).cast("long")).cast("int"))


def minimum_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Ships all supply to sinks within capacity at least cost, by successive shortest paths.

    The graph has one node per old and per new shard, so its size never depends on the data.
    `cost(source, sink)` is per byte. Capacities must add up to the supply at least.
    """
    sources, sinks = [s for s in supply if supply[s]], [t for t in capacity if capacity[t]]
    nodes = ["S", *[("s", s) for s in sources], *[("t", t) for t in sinks], "T"]
    index = {n: i for i, n in enumerate(nodes)}
    edges: list[list[int]] = []  # to, room, cost; the reverse edge is the next one
    out: list[list[int]] = [[] for _ in nodes]

    def edge(a, b, room, price):
        out[index[a]].append(len(edges))
        edges.append([index[b], room, price])
        out[index[b]].append(len(edges))
        edges.append([index[a], 0, -price])

    for s in sources:
        edge("S", ("s", s), supply[s], 0)
    direct = {}
    for s in sources:
        for t in sinks:
            direct[s, t] = len(edges)
            edge(("s", s), ("t", t), supply[s], cost(s, t))
    for t in sinks:
        edge(("t", t), "T", capacity[t], 0)
    potential = [0] * len(nodes)
    end = index["T"]
    while True:
        far = [float("inf")] * len(nodes)
        came = [-1] * len(nodes)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            for e in out[v]:
                to, room, price = edges[e]
                reach = d + price + potential[v] - potential[to]
                if room and reach < far[to]:
                    far[to], came[to] = reach, e
                    heapq.heappush(queue, (reach, to))
        if far[end] == float("inf"):
            break
        potential = [p + (f if f < float("inf") else far[end]) for p, f in zip(potential, far)]
        room, v = float("inf"), end
        while v:
            room = min(room, edges[came[v]][1])
            v = edges[came[v] ^ 1][0]
        v = end
        while v:
            edges[came[v]][1] -= room
            edges[came[v] ^ 1][1] += room
            v = edges[came[v] ^ 1][0]
    return {st: edges[e ^ 1][1] for st, e in direct.items() if edges[e ^ 1][1]}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: (j + 1) * total // shards - j * total // shards for j in range(shards)}


def deal_blocks(
    sizes: dict[tuple[int, int], int], flow: dict[tuple[int, int], int], capacity: dict[int, int]
) -> dict[tuple[int, int], int]:
    """A new shard for every block.

    Large blocks first: a block goes to the shard with most of the flow of its old shard still
    open while it fits there, else to the shard with most room left. Small blocks come last and
    level the shards.
    """
    open_flow: dict[int, dict[int, int]] = defaultdict(dict)
    for (s, t), amount in flow.items():
        open_flow[s][t] = amount
    room = dict(capacity)
    placed: dict[tuple[int, int], int] = {}
    roomiest = [(-r, t) for t, r in room.items()]
    heapq.heapify(roomiest)
    for block in sorted(sizes, key=lambda b: (-sizes[b], b)):
        size = sizes[block]
        wants = open_flow[block[0]]
        fitting = [(min(amount, room[t]), t == block[0], -t) for t, amount in wants.items() if min(amount, room[t]) >= size]
        if fitting:
            target = -max(fitting)[2]
            wants[target] -= size
        else:
            while -roomiest[0][0] != room[roomiest[0][1]]:
                heapq.heapreplace(roomiest, (-room[roomiest[0][1]], roomiest[0][1]))
            target = roomiest[0][1]
        room[target] -= size
        placed[block] = target
        heapq.heappush(roomiest, (-room[target], target))
    return placed


def reshard_plan(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """old_shard, block, shard and the first slot of the block; one row per block."""
    spark = rows.sparkSession
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sizes = {(r["old_shard"], r["block"]): r["bytes"] for r in blocks}
    counts = {(r["old_shard"], r["block"]): r["n"] for r in blocks}
    supply: dict[int, int] = defaultdict(int)
    for (s, _), size in sizes.items():
        supply[s] += size
    capacity = even_capacities(sum(supply.values()), shards)
    flow = minimum_cost_flow(supply, capacity, lambda s, t: 0 if s == t else 1)
    placed = deal_blocks(sizes, flow, capacity)
    first: dict[int, int] = defaultdict(int)
    plan = []
    for block in sorted(placed):
        shard = placed[block]
        plan.append((block[0], block[1], shard, first[shard]))
        first[shard] += counts[block]
    return spark.createDataFrame(plan, "old_shard int, block int, shard int, first_slot long")


def resharded(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Adds shard and slot to rows that have doc_id, text, size, text_crc32 and old_shard.

    The plan has at most `blocks` rows and a few more, so it is broadcast. Rows travel once, to
    the range of (shard, block) they belong to, and are numbered inside their block.
    """
    cut = with_blocks(rows, blocks)
    plan = reshard_plan(cut, shards)
    inside = W.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        cut.join(F.broadcast(plan), ["old_shard", "block"])
        .repartitionByRange(partitions(rows.sparkSession), "shard", "old_shard", "block")
        .withColumn("slot", F.col("first_slot") + F.row_number().over(inside) - 1)
        .drop("first_slot")
    )


def rewrite_affected(rows: DataFrame, folder: str) -> list[int]:
    """Writes the shards whose rows change as `folder`/shard=N and returns their numbers.

    A shard is affected if a row leaves or enters it. The others keep their old files. `rows` is
    what `resharded` returns; the list has at most as many entries as there are shards.
    """
    moved = rows.where("old_shard <> shard")
    touched = moved.select(F.col("shard")).union(moved.select("old_shard")).distinct()
    shards = sorted(r[0] for r in touched.collect())
    affected = rows.where(F.col("shard").isin(shards))
    affected.write.partitionBy("shard").mode("overwrite").parquet(folder)
    return shards


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old shards are 32 buckets of `source`, as a table stored by source would lie; new are 40."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS)).cast("int")
    rows = sized(docs).withColumn("old_shard", old).drop("source")
    new = resharded(rows)
    folder = scratch_folder(spark, "shards")
    # every one of the 40 shards receives rows here, since a third of the rows leave one old shard
    new.write.partitionBy("shard").parquet(folder)
    stored = spark.read.schema(new.schema).parquet(folder)
    return stored.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op5_flow_resharding": op5_flow_resharding}
SQL: dict[str, str] = {}
