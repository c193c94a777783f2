"""Operator 2: quality rules on tokeniser fertility.

Public vocabularies measure every whole text: characters per token of a byte-level BPE for many
languages, the share of pieces that a sentence-piece BPE can only spell as bytes, and the entropy of
the byte-level ids as a share of what their number allows. Each language (the dominant script where
no language is given) has a band per measure: the median of its documents, plus and minus a number
of robust deviations that grows for short texts. The entropy falls with the length of a text, so its
bands are also told apart by powers of two of the words, which a bad text cannot raise as it raises
its tokens. A band of fewer than `THIN` documents is not used: the entropy takes the language's
nearest length, its deviation multiplied by one plus the distance, and a language without a band of
its own takes its script's. The deviation is the median distance from the median, and a source with
more documents in a band than the mean source has the votes of a mean one, so that neither a third of
bad documents nor one large source sets a band. Apart from the bands, a text of nearly single bytes
for its language's script, half spelled as bytes or of hardly any entropy is dropped (`LEAST_CHARS`,
`MOST_BYTES`, `LEAST_ENTROPY`). Medians and deviations are exact, over all documents that pass the base
rules, from counts of rounded values. A document is kept if it passes the base rules and lies inside
every band.

Words are `[^\\x20\\x09-\\x0D]+`. Null texts have no words. Rows with a null id or repeated rows are
measured like any other. With fewer documents than `THIN` in a script, its thin bands are all there is.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.llm.common import OTHER_SPACE, UnitTable, gathered, process_cache, settled, table

MIN_WORDS = 50
REPEAT_SHARE = 50
WIDTH = 6.0
SHORT = 100
"""Tokens at which a band is wider than for a very long text by the square root of two."""

# least deviation of each measure, so that a uniform language does not reject its own
MEASURES = {"chars_per_token": 0.04, "byte_share": 0.01, "entropy": 0.01}
THIN = 30
BY_LENGTH = ("entropy",)
VOTES = 1000
"""Votes of a document whose source is no larger than the mean; votes are whole numbers."""

# characters per token that no text of these scripts stays under; a byte a token is 1, 1/2 and 1/3
LEAST_CHARS = {"latin": 1.4, "cyrillic": 0.55, "greek": 0.55, "armenian": 0.55, "hebrew": 0.55, "arabic": 0.55}
LEAST_CHARS_OTHER = 0.36
MOST_BYTES = 0.5
LEAST_ENTROPY = 0.2
_LANGUAGES = {
    "latin": "af ca cs cy da de en eo es et eu fi fr ga gl hr hu id is it la lt lv ms nl no nb nn pl pt ro sk sl sq sv sw tl tr vi",
    "cyrillic": "be bg kk ky mk mn ru tg uk",
    "greek": "el",
    "armenian": "hy",
    "hebrew": "he yi",
    "arabic": "ar fa ur ps",
    "indic": "bn gu hi kn ml mr ne pa si ta te",
    "thai": "th lo",
    "han": "zh",
    "kana": "ja",
    "hangul": "ko",
}
_SCRIPTS = {language: script for script, names in _LANGUAGES.items() for language in names.split()}
_SYMBOLS = b"#*$%&|<>"
_GROUP_WORDS = 100_000


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_encoding(path: str):
    """The encoding of a rank file, loaded once per worker."""
    cache = process_cache()
    if ("ranks", path) not in cache:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        cache["ranks", path] = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return cache["ranks", path]


def _pieces(path: str):
    cache = process_cache()
    if ("pieces", path) not in cache:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [int(model.is_byte(i)) for i in range(model.get_piece_size())]
        cache["pieces", path] = (model, spelled)
    return cache["pieces", path]


def _word_encoder(ranks: str, pieces: str):
    """Word -> pieces, pieces spelled as bytes, code points, then its byte-level ids."""
    encoding = rank_encoding(ranks)
    model, spelled = _pieces(pieces)

    def encode(words: list[str]) -> list[list[int]]:
        found = []
        for word, ids in zip(words, model.encode(words, num_threads=1)):
            found.append([len(ids), sum(map(spelled.__getitem__, ids)), len(word), *encoding.encode_ordinary(" " + word)])
        return found

    return encode


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more in the text.

    Equal words have equal numbers.
    """
    if len(numbers) < 3:
        return 0
    if numbers.max() < 1 << 21:
        windows = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        pairs = np.unique((numbers[:-1] << 32) | numbers[1:], return_inverse=True)[1].astype(np.int64)
        windows = (pairs[:-1] << 32) | numbers[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    often = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    hit = np.zeros(len(numbers), bool)
    for k in range(3):
        hit[often + k] = True
    return int(hit.sum())


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and \\t to \\r."""
    if OTHER_SPACE.search(text):
        return [w.decode("utf-8") for w in text.encode("utf-8", "replace").split()]
    return text.split()


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _script(text: str) -> str:
    """The script of most letters, told by Unicode range; Latin where there is none."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    starts = np.array([0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0780, 0x0900, 0x0E00, 0x1100, 0x3040, 0x3100, 0xAC00, 0xD7B0])
    names = ("latin greek cyrillic armenian hebrew arabic other indic thai other kana han hangul other").split()
    letters = points[(points >= 0x41) & ((points <= 0x2FF) | (points >= 0x370))]
    if not len(letters):
        return "latin"
    return names[int(np.bincount(np.searchsorted(starts, letters, side="right")).argmax())]


def _language_and_script(lang: str | None, text: str) -> tuple[str, str]:
    """A known language has its own script, whatever the text is written in."""
    script = _SCRIPTS.get(re.split("[-_]", lang.lower())[0]) if lang else None
    script = script or _script(text)
    return lang or script, script


def _entropy_share(ids: np.ndarray) -> float:
    if len(ids) < 2:
        return 1.0
    counts = np.unique(ids, return_counts=True)[1]
    p = counts / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(len(ids)))


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "language string, script string, band string, n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def measured(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """All columns of `docs`, the base counts and the measures of every whole text."""
    names = docs.columns
    with_lang = "lang" in names

    def rows_of(texts: list[str], langs: list, known: UnitTable) -> list[tuple]:
        out = []
        for text, lang in zip(texts, langs):
            strings = words_of(text)
            parts, codes = [], np.zeros(0, np.int64)
            for at in range(0, len(strings), _GROUP_WORDS):
                codes = known.look_up(strings[at : at + _GROUP_WORDS])
                begin, size = known.starts[codes], known.lengths[codes]
                parts.append((known.flat[begin], known.flat[begin + 1], known.flat[begin + 2], gathered(known.flat, begin + 3, size - 3)))
            if len(parts) > 1:
                # the table may have been emptied in between, so a long text numbers its own words
                own: dict[str, int] = {}
                codes = np.fromiter((own.setdefault(w, len(own)) for w in strings), np.int64, len(strings))
            if parts:
                piece, spelled, chars, ids = (np.concatenate([p[k] for p in parts]) for k in range(4))
            else:
                piece = spelled = chars = ids = np.zeros(0, np.int64)
            n, word_chars = len(strings), int(chars.sum())
            raw = text.encode("utf-8", "replace")
            symbols = sum(raw.count(bytes([b])) for b in _SYMBOLS)
            again = repeated_words(codes)
            language, script = _language_and_script(lang, text)
            failed = n < MIN_WORDS or 100 * again > REPEAT_SHARE * n
            out.append(
                (
                    n,
                    word_chars,
                    symbols,
                    repeated_lines(text),
                    again,
                    failed,
                    language,
                    script,
                    f"{language}:{n.bit_length()}",
                    len(ids),
                    word_chars / len(ids) if len(ids) else 0.0,
                    float(spelled.sum() / piece.sum()) if len(piece) else 0.0,
                    _entropy_share(ids),
                )
            )
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitTable(_word_encoder(ranks, pieces), capacity=400_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs = part.column("lang").to_pylist() if with_lang else [None] * len(texts)
                columns = list(zip(*rows_of(texts, langs, known)))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _arrow_fields())]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(names))], *arrays], [*names, *[f.name for f in _arrow_fields()]]
                )

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_FIELDS).fields])
    return docs.mapInArrow(run, schema)


def _arrow_fields() -> list[pa.Field]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    return [pa.field(*(lambda a, b: (a, kinds[b]))(*f.split())) for f in _FIELDS.split(", ")]


def _length():
    """Binary digits of the number of words."""
    return F.length(F.bin("n_words"))


def _spreads(counts: DataFrame) -> DataFrame:
    """key, length, measure, docs, middle and deviation of counted values, large sources held to the mean one."""
    keys = ["key", "length", "measure"]
    sources = counts.groupBy(*keys, "source").agg(F.sum("n").alias("size"))
    means = sources.groupBy(*keys).agg(F.avg("size").alias("mean"), F.sum("size").alias("docs"))
    votes = F.greatest(F.lit(1), F.round(VOTES * F.least(F.lit(1.0), F.col("mean") / F.col("size")))).cast("long")
    weighed = sources.join(means, keys).select(*keys, "source", votes.alias("votes"))
    values = counts.join(weighed, [*keys, "source"]).groupBy(*keys, "value").agg(F.sum(F.col("n") * F.col("votes")).alias("n"))
    # a band's map of rounded values has a few thousand entries at most
    middles = values.groupBy(*keys).agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("mid"))
    apart = F.percentile(F.round(F.abs(F.col("value") - F.col("mid")), 4), F.lit(0.5), F.col("n"))
    found = values.join(middles, keys).groupBy(*keys).agg(F.first("mid").alias("mid"), (1.4826 * apart).alias("dev"))
    return found.join(means.select(*keys, "docs"), keys)


def bands(rows: DataFrame) -> DataFrame:
    """language, script, length, and middle and deviation of every measure to judge such documents by."""
    good = rows.where(~F.col("base_failed")).withColumn("length", _length())
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, 3).alias("value"), F.lit(m in BY_LENGTH).alias("by")) for m in MEASURES])
    levels = F.array(F.concat(F.lit("language "), "language"), F.concat(F.lit("script "), "script"))
    source = F.coalesce("source", F.lit("")) if "source" in rows.columns else F.lit("")
    good = good.select("language", "script", "length", source.alias("source"), *MEASURES)
    counts = (
        good.select("language", "script", "length", "source", F.inline(values))
        .withColumn("length", F.when(F.col("by"), F.col("length")).otherwise(0))
        .groupBy("language", "script", "length", "source", "measure", "value")
        .agg(F.count("*").alias("n"))
        .select("length", "source", "measure", "value", "n", F.explode(levels).alias("key"))
        .groupBy("key", "length", "source", "measure", "value")
        .agg(F.sum("n").alias("n"))
    )
    least = F.element_at(F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair]), F.col("measure"))
    found = settled(_spreads(settled(counts)).withColumn("dev", F.greatest("dev", least))).withColumnRenamed("length", "of")
    wanted = good.select("language", "script", "length").distinct().select("*", F.posexplode(levels).alias("rank", "key"))
    thin = F.col("docs") < THIN
    apart = F.when(F.col("of") > 0, F.abs(F.col("of") - F.col("length"))).otherwise(0)
    # of thin bands the script's
    order = F.struct(thin.alias("thin"), F.when(thin, -F.col("rank")).otherwise(F.col("rank")).alias("rank"), apart.alias("apart"), "mid", "dev")
    chosen = wanted.join(found, "key").groupBy("language", "script", "length", "measure").agg(F.min(order).alias("b"))
    chosen = chosen.select("*", F.col("b.mid").alias("mid"), (F.col("b.dev") * (1 + F.col("b.apart"))).alias("dev"))
    columns = [F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}") for m in MEASURES for x in ("mid", "dev")]
    return chosen.groupBy("language", "script", "length").agg(*columns)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `kept` to measured rows."""
    wide = F.sqrt(1 + SHORT / F.greatest("n_tokens", F.lit(1)))
    least = F.lit(LEAST_CHARS_OTHER)
    for script, chars in LEAST_CHARS.items():
        least = F.when(F.col("script") == script, chars).otherwise(least)
    inside = (F.col("chars_per_token") >= least) & (F.col("byte_share") <= MOST_BYTES) & (F.col("entropy") >= LEAST_ENTROPY)
    for name in MEASURES:
        off = F.abs(F.col(name) - F.col(f"{name}_mid"))
        inside = inside & F.coalesce(off <= WIDTH * wide * F.col(f"{name}_dev"), F.lit(True))
    drop = ["length", *[f"{n}_{x}" for n in MEASURES for x in ("mid", "dev")]]
    # a row for each language and power of two; a shuffle would send most documents to a few tasks
    both = rows.withColumn("length", _length()).join(F.broadcast(limits), ["language", "script", "length"], "left")
    return both.withColumn("kept", ~F.col("base_failed") & inside).drop(*drop)


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = settled(measured(docs, rank_path(), piece_path()).drop("text", "lang"))
    return judged(rows, bands(rows)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "band",
        *MEASURES,
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base rules or leave a band go.

    Texts are measured once; the verdicts travel by a row number that is fixed in the written table.
    """
    rows = settled(measured(docs.select("doc_id", "text", "lang", "source"), rank_path(), piece_path()).drop("lang").withColumn("_key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).drop("text"))
    good = judged(rows, bands(rows)).where("kept").select("doc_id", F.col("_key")).distinct()
    left = docs.withColumn("_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    match = left["doc_id"].eqNullSafe(good["doc_id"]) & (left["_key"] == good["_key"])
    return left.join(good, match, "left_semi").drop("_key")


QUERIES = {"op2_tokenizer_fertility": op2_tokenizer_fertility}
SQL: dict[str, str] = {}
