"""Operator 12: Merkle dataset manifest by a nested-struct rollup.

Every row is a leaf; the leaves of a language ascend by id, and every two neighbours (a last one
alone) are hashed into their parent until one is left, the language's subroot. The subroots, by
language, give the root in the same way.

A rank in base 16 names the place of a leaf in the tree. Ranks are dealt into blocks of 4096 (three
digits), one shuffle brings a block together, and its digit columns are grouped away one after the
other: each grouping nests the child structs of 16 ranks and hashes up to four levels over them, so
a block ends as one nested struct of bounded size. The blocks' roots are ranked by their block
number already and are rolled up the same way, as often as needed. On the way down a final transform
of the nested struct and one explode emit every leaf with its siblings, without a join inside a
block. Only the path above a block, one row per block, is joined to it: a struct that held a whole
language could not be bounded.

Defined cases: null columns are written `-` in a leaf; a null language is a group of its own and
comes first, a null id comes first in its language and is never tampered with. Rows equal in id are
ordered by their leaf; equal rows are hashed once, ranked as one run and cut into blocks, so copies
of one row cost no more than their share. An empty table gives no rows. Columns other than FIELDS
are not read, so their names cannot clash; long texts are hashed where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import settled, table
from tractlens.operators.scale import running_totals

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGIT_BITS = 4
DIGITS = 3
BLOCK = 1 << (DIGIT_BITS * DIGITS)
TAMPER_MODULUS = 7

# the hex digest of an expression
_HASH = "sha2(cast({} as binary), 256)"
# hashes of neighbours in pairs, the last one alone where their number is odd
_PAIRS = (
    "transform(sequence(0, (size({x}) - 1) div 2), i -> "
    + _HASH.format("concat(get({x}, 2 * i), coalesce(get({x}, 2 * i + 1), ''))")
    + ")"
)


def leaf_hash(fields: Sequence[str | Column] = FIELDS) -> Column:
    """The digest of a row: each field as byte count, colon and value, or `-` where it is null."""
    parts = []
    for field in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        size = F.octet_length(value).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _levels_of(total: str) -> str:
    """Levels of a tree over `total` leaves."""
    return f"if({total} > 1, length(bin({total} - 1)), 0)"


def _rolled(nodes: DataFrame, keys: list[str], digit: str, done: int) -> DataFrame:
    """Groups a digit away: its nodes become the `kids` of one node, hashed level by level."""
    kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("d"), "node")))
    held = nodes.groupBy(*keys).agg(kids.alias("kids"), F.first("total").alias("total"))
    held = held.withColumn("steps", F.expr(f"greatest(0, least({DIGIT_BITS}, {_levels_of('total')} - {done}))"))
    grown = F.expr(
        f"aggregate(sequence(1, {DIGIT_BITS}), array(transform(kids, k -> k.node.h)), (made, s) -> "
        f"if(s <= steps, concat(made, array({_PAIRS.format(x='element_at(made, -1)')})), made))"
    )
    held = held.withColumn("levels", grown)
    node = F.struct(F.expr("element_at(element_at(levels, -1), 1)").alias("h"), "levels", "steps", "kids")
    return held.select(*keys, "total", node.alias("node"))


def grown(pieces: DataFrame) -> list[DataFrame]:
    """Rolls ranked leaves up: one table of block trees per round, the last of one block a group.

    `pieces` holds runs of equal leaves: group `g`, ranks `first` to `last`, the group's `total`,
    the leaf's digest `h` (binary) and `payload`.
    """
    rounds: list[DataFrame] = []
    blocks = F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}")))
    spread = pieces.withColumn("block", blocks).repartition("g", "block")
    inside = F.sequence(
        F.greatest(F.col("first"), F.col("block") * BLOCK), F.least(F.col("last"), F.col("block") * BLOCK + (BLOCK - 1))
    )
    ranked = spread.withColumn("rank", F.explode(inside))
    node = F.struct(F.lower(F.hex("h")).alias("h"), "payload")
    while True:
        digits = [f"d{i}" for i in range(DIGITS)]
        places = [F.expr(f"cast(shiftright(rank, {DIGIT_BITS * i}) & {(1 << DIGIT_BITS) - 1} as int)") for i in range(DIGITS)]
        tree = ranked.select(
            "g", "block", "total", node.alias("node"), *[p.alias(d) for p, d in zip(places, digits)]
        )
        depth = DIGIT_BITS * DIGITS * len(rounds)
        for i, digit in enumerate(digits):
            tree = _rolled(tree, ["g", "block", *digits[i + 1 :]], digit, depth + DIGIT_BITS * i)
        rounds.append(settled(tree))
        most = rounds[-1].agg(F.max("block")).first()[0]
        if not most:
            return rounds
        above = rounds[-1].select("g", F.col("block").alias("rank"), "total", F.col("node.h").alias("h"))
        node = F.struct("h", F.struct(F.col("rank").alias("block")).alias("payload"))
        ranked = above.withColumn("block", F.expr(f"rank div {BLOCK}")).repartition("g", "block")


def _siblings(node: str, digit: str) -> str:
    """The siblings met from a child of a node up to the node, null where there is none."""
    return (
        f"transform(slice(array(0, 1, 2, 3), 1, {node}.steps), s -> named_struct("
        f"'h', get(get({node}.levels, s), shiftright({digit}, s) ^ 1), 'left', (shiftright({digit}, s) & 1) = 1))"
    )


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The payload of every leaf, its digest and its path, for groups with their own path in `tops`.

    `tops` holds `g`, `path` and columns that every leaf of the group gets.
    """
    carried = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tree in reversed(rounds):
        path = f"concat({_siblings('k1.node', 'k0.d')}, {_siblings('k2.node', 'k1.d')}, {_siblings('node', 'k2.d')}, path)"
        leaf = f"named_struct('payload', k0.node.payload, 'h', k0.node.h, 'path', {path})"
        emitted = (
            f"inline(flatten(transform(node.kids, k2 -> flatten(transform(k2.node.kids, k1 -> "
            f"transform(k1.node.kids, k0 -> {leaf}))))))"
        )
        emitted_rows = tree.join(above, ["g", "block"]).select("g", *carried, F.expr(emitted))
        above = emitted_rows
        if tree is not rounds[0]:
            above = emitted_rows.select("g", *carried, "path", F.col("payload.block").alias("block"))
    return above


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and a path of siblings lead to."""

    def step(made: Column, sibling: Column) -> Column:
        other = F.coalesce(sibling["h"], F.lit(""))
        pair = F.when(sibling["left"], F.concat(other, made)).otherwise(F.concat(made, other))
        return F.sha2(pair, 256)

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path (its siblings) and tampered_leaf.

    `tampered` is the digest of an altered row where there is one; it takes no part in the tree.
    """
    altered = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(
        # null first, then bytewise
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("g"),
        "doc_id",
        F.unhex(leaf_hash()).alias("h"),
        F.unhex(altered).alias("altered"),
    )
    runs = leaves.groupBy("g", "doc_id", "h", "altered").agg(F.count("*").alias("copies"))
    ranked = running_totals(
        runs, ["g"], [F.col("doc_id"), F.col("h")], {"stop": F.col("copies")}, {"total": F.col("copies")}
    )
    pieces = ranked.select(
        "g",
        (F.col("stop") - F.col("copies")).alias("first"),
        (F.col("stop") - 1).alias("last"),
        "total",
        "h",
        F.struct("doc_id", "altered").alias("payload"),
    )
    rounds = grown(pieces)
    subroots = rounds[-1].select(F.col("g").alias("of"), F.col("node.h").alias("subroot"), F.lit("").alias("g"))
    one = F.lit(1).cast("long")
    placed = running_totals(subroots, ["g"], [F.col("of")], {"stop": one}, {"total": one})
    at = (F.col("stop") - 1).alias("first"), (F.col("stop") - 1).alias("last")
    top_rounds = grown(placed.select("g", *at, "total", F.unhex("subroot").alias("h"), F.struct("of").alias("payload")))
    no_path = F.expr("cast(array() as array<struct<h: string, left: boolean>>)")
    summit = top_rounds[-1].select("g", no_path.alias("path"), F.col("node.h").alias("root"))
    langs = descended(top_rounds, summit)
    tops = langs.select(F.col("payload.of").alias("g"), "path", F.col("h").alias("subroot"), "root")
    return descended(rounds, tops).select(
        F.col("payload.doc_id").alias("doc_id"),
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.lower(F.hex("payload.altered")).alias("tampered_leaf"),
    )


def op12_nested_rollup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where the modulus divides the id's crc32, n_chars is one too high."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    fields = [F.col("n_chars") + 1 if f == "n_chars" else f for f in FIELDS]
    rows = manifest(table(spark, sf_dir, "documents"), F.when(struck, leaf_hash(fields)))
    root = folded(F.coalesce("tampered_leaf", "leaf"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.concat_ws("", F.col("path.h")), 256).alias("proof_sha256"),
        root.alias("folded_root"),
        (root == F.col("root")).alias("verified"),
    )


QUERIES = {"op12_nested_rollup_manifest": op12_nested_rollup_manifest}
SQL = {
    "op12_nested_rollup_manifest": r"""
WITH RECURSIVE fields AS (
  SELECT coalesce('1' || lang, '0') AS g, doc_id,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
      lambda v: coalesce(strlen(v) || ':' || v, '-')) AS parts,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text],
      lambda v: coalesce(strlen(v) || ':' || v, '-')) AS struck_parts,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0 AS struck
  FROM documents
), hashed AS (
  SELECT g, doc_id, sha256(array_to_string(parts, '')) AS leaf,
    CASE WHEN struck THEN sha256(array_to_string(struck_parts, '')) END AS altered
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes AS (
  SELECT g, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS alive FROM nodes) WHERE alive > 1
  GROUP BY g, level, pos // 2
), depths AS (
  SELECT g, max(level) AS depth, max_by(h, level) AS subroot, row_number() OVER (ORDER BY g) - 1 AS lang_pos
  FROM nodes GROUP BY g
), upper_nodes AS (
  SELECT 0 AS level, lang_pos AS pos, subroot AS h FROM depths
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS alive FROM upper_nodes) WHERE alive > 1
  GROUP BY level, pos // 2
), top AS (
  SELECT max(level) AS height, max_by(h, level) AS root FROM upper_nodes
), steps AS (
  SELECT l.g, l.pos, s.level AS step, n.h AS h, (l.pos >> s.level) % 2 = 1 AS on_left
  FROM leaves l JOIN depths d USING (g), range(64) s(level)
    LEFT JOIN nodes n ON n.g = l.g AND n.level = s.level AND n.pos = xor(l.pos >> s.level, 1)
  WHERE s.level < d.depth
  UNION ALL
  SELECT l.g, l.pos, 64 + s.level, u.h, (d.lang_pos >> s.level) % 2 = 1
  FROM leaves l JOIN depths d USING (g) CROSS JOIN top, range(64) s(level)
    LEFT JOIN upper_nodes u ON u.level = s.level AND u.pos = xor(d.lang_pos >> s.level, 1)
  WHERE s.level < top.height
), paths AS (
  SELECT g, pos, list({'h': coalesce(h, ''), 'on_left': on_left} ORDER BY step) AS path FROM steps GROUP BY g, pos
), proven AS (
  SELECT l.doc_id, l.leaf, d.subroot, top.root,
    sha256(coalesce(array_to_string(list_transform(p.path, lambda s: s.h), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'h': coalesce(l.altered, l.leaf), 'on_left': false}, coalesce(p.path, [])),
      lambda a, s: {'h': sha256(CASE WHEN s.on_left THEN s.h || a.h ELSE a.h || s.h END), 'on_left': false}).h AS folded_root
  FROM leaves l JOIN depths d USING (g) CROSS JOIN top LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM proven
"""
}
