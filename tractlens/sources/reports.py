"""Result exports: figure panels, nested results as paths, manifests, report tables."""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.functions.digests import sha256_end, sha256_step, sha256_steps
from tractlens.operators.scale import numbered, settled
from tractlens.session import scratch_folder

DASH = "--"
PIECE = 128 << 20
_ROW_BYTES = 64 << 10


def write_panel(df: DataFrame, folder: str, name: str, tag: str = "") -> str:
    """One CSV folder per panel; the name carries the extractor tag."""
    target = f"{folder}/{name}{'_' + tag if tag else ''}"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def _leaves(schema: T.StructType, path: str = "", col: Column | None = None):
    for field in schema.fields:
        here = f"{path}.{field.name}" if path else field.name
        value = F.col(f"`{field.name}`") if col is None else col.getField(field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here, value)
        elif isinstance(field.dataType, T.NumericType):
            yield here, value


def flatten_results(nested: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, path, value) of every number of nested result documents, one document a row."""
    inner = nested.drop(*keys).schema
    rows = [F.struct(F.lit(p).alias("path"), v.cast("double").alias("value")) for p, v in _leaves(inner)]
    long = nested.select(*keys, F.explode(F.array(*rows)).alias("e"))
    return long.select(*keys, "e.path", "e.value").where("value IS NOT NULL")


def read_results(spark: SparkSession, path: str, keys: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """Result documents: one per file, or one per line."""
    return flatten_results(spark.read.json(path, multiLine=not lines), keys)


def nested_results(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Documents of any depth from paths: keys and `document`, a JSON text.

    Paths are folded from the deepest level up, all documents at once: the entries of a parent become
    its text. A path that is both a number and a parent is an error.
    """
    keys = list(keys)
    parts = values.select(*keys, F.split("path", r"\.").alias("parts"), F.col("value").cast("string").alias("text"))
    parts = settled(parts.where(F.col("text").isNotNull()))
    depth = parts.agg(F.max(F.size("parts"))).first()[0] or 0
    rows = parts
    for level in range(depth, 0, -1):
        here, above = rows.where(F.size("parts") == level), rows.where(F.size("parts") < level)
        name = F.to_json(F.array(F.element_at("parts", -1)))
        # a JSON text of the name without the brackets of its array
        entry = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("text"))
        folded = (
            here.groupBy(*keys, F.slice("parts", 1, level - 1).alias("parts"))
            .agg(
                F.array_sort(F.collect_list(entry)).alias("entries"),
                F.count("*").alias("n"),
                F.countDistinct(F.element_at("parts", -1)).alias("names"),
            )
            .withColumn(
                "text",
                F.when(F.col("n") == F.col("names"), F.concat(F.lit("{"), F.array_join("entries", ","), F.lit("}"))).otherwise(
                    F.raise_error(F.concat(F.lit("two results at one path below: "), F.array_join("parts", ".")))
                ),
            )
        )
        rows = folded.select(*keys, "parts", "text").unionByName(above)
    return rows.select(*keys, F.col("text").alias("document"))


def write_results(values: DataFrame, folder: str, keys: Sequence[str] = ()) -> None:
    """One document a line; the keys become members of each document."""
    documents = nested_results(values, keys)
    if keys:
        names = F.to_json(F.struct(*keys))
        body = F.substring("document", F.lit(2), F.length("document"))
        documents = documents.select(F.concat(F.substring(names, F.lit(1), F.length(names) - 1), F.lit(","), body).alias("document"))
    documents.select("document").write.mode("overwrite").text(folder)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each packaged file.

    A file of at most `PIECE` bytes is one row. The digest of a longer one is a chain over its bytes:
    it is cut into pieces, a task reads one of them, and the state of the digest goes on to the next
    task. All long files take each step together.
    """
    files = spark.read.format("binaryFile").load(path)
    entry = F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length"
    digest = F.sha2("content", 256).alias("sha256")
    packed = F.lower("path").rlike(r"\.(gz|bz2|zst|zstd|xz|lz4|snappy|deflate)$")  # a text reader would unpack it
    names = "path", F.col("_metadata.file_path").alias("where"), "length", packed.alias("packed")
    long = files.where(F.col("length") > PIECE).select(*names).collect() if sha256_steps() else []
    chained = [r for r in long if not r["packed"]]
    if not chained:
        return files.select(*entry, digest)
    # the reader knows the length of a file before it opens it
    found = files.where(F.col("length") <= PIECE).select(*entry, digest)
    if len(chained) < len(long):
        found = found.unionByName(spark.read.format("binaryFile").load([r["path"] for r in long if r["packed"]]).select(*entry, digest))
    digests = _chained_digests(_settled_pieces(spark, [r["path"] for r in chained]), {r["where"]: r["length"] for r in chained})
    rows = [(r["path"], r["length"], digests[r["where"]]) for r in chained]
    return found.unionByName(spark.createDataFrame(rows, "path string, length long, sha256 string").select(*entry, "sha256"))


def _chained_digests(pieces: DataFrame, lengths: dict[str, int]) -> dict[str, str]:
    """SHA-256 of long files, by path."""
    found = {r["path"]: r["n"] for r in pieces.groupBy("path").agg(F.sum(F.length("bytes")).alias("n")).collect()}
    # every line was closed, also a last one that is open; and the reader drops the mark of a text in UTF-8
    marked = {p for p, n in lengths.items() if n - found[p] in (2, 3)}
    left = {p: n - (len(codecs.BOM_UTF8) if p in marked else 0) for p, n in lengths.items()}
    if any(found[p] - n not in (0, 1) for p, n in left.items()):
        raise ValueError("a file changed while it was read")
    states = {p: sha256_step(None, codecs.BOM_UTF8 if p in marked else b"") for p in lengths}
    for (step,) in pieces.select("step").distinct().orderBy("step").collect():
        here = pieces.where(F.col("step") == step).select("path", "block", "number", "bytes")
        here = here.repartition(len(lengths), "path").sortWithinPartitions("path", "block", "number")
        for r in here.mapInArrow(_chain(states, left), "path string, state binary, n long").collect():
            states[r["path"]] = bytes(r["state"])
            left[r["path"]] -= r["n"]
    return {p: sha256_end(s) for p, s in states.items()}


def _chain(states: dict[str, bytes], left: dict[str, int]):
    """Leads the digests on over the pieces of one step; no digest takes more bytes than are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, tuple[bytes, int]] = {}
        for batch in batches:
            for path, part in zip(batch.column("path").to_pylist(), batch.column("bytes")):
                state, taken = now.get(path, (states[path], 0))
                data = part.as_py()[: left[path] - taken]
                now[path] = sha256_step(state, data), taken + len(data)
        rows = [(p, s, n) for p, (s, n) in now.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "state", "n"])

    return run


def _settled_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, block, number, bytes, step of files: their bytes in order, with a line feed behind the last line.

    Spark's reader of text cuts a file at line feeds, so its tasks share the file; no other byte counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("path", "block", "line")))

        for (path, block), group in groupby(lines(), key=lambda r: r[:2]):
            held, size, number = [], 0, 0
            for _, _, line in group:
                held.append(line)
                size += len(line) + 1
                if size >= _ROW_BYTES:
                    yield piece(path, block, number, held)
                    held, size, number = [], 0, number + 1
            if held:
                yield piece(path, block, number, held)

    def piece(path, block, number, held):
        columns = [pa.array([path]), pa.array([block]), pa.array([number], pa.int32()), pa.array([b"\n".join([*held, b""])])]
        return pa.RecordBatch.from_arrays(columns, ["path", "block", "number", "bytes"])

    text = spark.read.option("lineSep", "\n").text(paths)
    lines = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    cut = lines.mapInArrow(run, "path string, block long, number int, bytes binary")
    folder = scratch_folder(spark, "pieces")
    cut.withColumn("step", F.floor(F.col("block") / PIECE)).write.partitionBy("step").parquet(folder)
    return spark.read.schema("path string, block long, number int, bytes binary, step long").parquet(folder)


def split_listing(partition: DataFrame) -> DataFrame:
    """Cities of each split in order, one row per city."""
    return numbered(partition.select("split", "city"), ["split"], [F.col("city").asc()], "place")


# ---- report tables ------------------------------------------------------------------------


def fixed(value: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit(DASH))


def with_interval(value: Column, low: Column, high: Column, digits: int = 3) -> Column:
    text = F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", value, low, high)
    return F.when(value.isNull(), F.lit(DASH)).otherwise(text)


def signed_interval(value: Column, low: Column, high: Column, digits: int = 3) -> Column:
    text = F.format_string(f"%+.{digits}f [%+.{digits}f, %+.{digits}f]", value, low, high)
    return F.when(value.isNull(), F.lit(DASH)).otherwise(text)


def report_table(results: DataFrame, names: DataFrame, systems: Sequence[str]) -> DataFrame:
    """One row per named split and metric, one text column per system; a missing one is a dash."""
    cell = with_interval(F.col("value"), F.col("low"), F.col("high"))
    wide = (
        results.withColumn("_cell", cell).groupBy("split", "metric").pivot("system", list(systems)).agg(F.first("_cell"))
    )
    # a metric without a name is shown under its own
    return wide.join(names, "metric", "left").select(
        "split", F.coalesce("label", "metric").alias("label"), *[F.coalesce(s, F.lit(DASH)).alias(s) for s in systems]
    )
