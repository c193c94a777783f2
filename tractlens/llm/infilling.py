"""Operator 13: fill-in-middle transformation with a learned index of cut places.

A text is a row of tokens, `[A-Za-z]+` or one other character, and may be cut after any of them. The
offsets of all boundaries, by rank, are close to a straight line over short stretches, so they are
kept as an error-bounded piecewise-linear function of the rank (`RankIndex`): segments whose line
misses no boundary by more than `ERROR` characters, and one signed byte per boundary that corrects
the line. A cut is predicted by its segment and then corrected, so it is exact.

Ranks of the two cuts, and the form, are hashes of the document id, so a lost task repeats itself.
`transformed` gives the text rearranged for training, `restored` the text back from it.

Defined cases: a null text counts as empty and stays plain; a null id hashes as an empty one; rows
that repeat an id are transformed alike, each for its own text; a text of any length is cut whole
(its task holds about 15 bytes per character while it does so). Columns of the input other than
`doc_id` and `text` are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import table, text_groups

ERROR = 127
"""Largest distance between a boundary and the line of its segment; one byte holds it."""
FIRST_SEGMENT = 512
GROUP_CHARS = 1 << 20
PLAIN_SHARE, SPM_SHARE = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class RankIndex:
    """Boundary offsets by rank, for several texts at once.

    `offsets` holds the offsets of every text from rank 0 (offset 0) to its last rank, one text
    after the other; `firsts` holds the place of every text's rank 0.
    """

    def __init__(self, offsets: np.ndarray, firsts: np.ndarray, error: int = ERROR):
        self.firsts = firsts
        self.residuals = np.zeros(len(offsets), np.int8)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts, stops = self._pieces(firsts, np.append(firsts[1:], len(offsets)), FIRST_SEGMENT)
        while len(starts):
            sizes = stops - starts
            heads = np.cumsum(sizes) - sizes
            places = np.repeat(starts - heads, sizes) + np.arange(sizes.sum())
            slopes = (offsets[stops - 1] - offsets[starts]) / np.maximum(sizes - 1, 1)
            steps = places - np.repeat(starts, sizes)
            away = offsets[places] - np.floor(np.repeat(slopes, sizes) * steps).astype(np.int64)
            low, high = np.minimum.reduceat(away, heads), np.maximum.reduceat(away, heads)
            bases = (low + high) // 2
            # a line through two boundaries meets both, so halving always ends
            good = (high - bases <= error) & (bases - low <= error)
            kept = np.repeat(good, sizes)
            self.residuals[places[kept]] = (away - np.repeat(bases, sizes))[kept]
            done.append((starts[good], bases[good], slopes[good]))
            bad_starts, bad_stops = starts[~good], stops[~good]
            halves = (bad_starts + bad_stops) // 2
            starts, stops = np.append(bad_starts, halves), np.append(halves, bad_stops)
        self.starts, self.bases, self.slopes = (np.concatenate(x) if x else np.zeros(0) for x in zip(*done))
        order = np.argsort(self.starts)
        self.starts, self.bases, self.slopes = self.starts[order], self.bases[order], self.slopes[order]

    @staticmethod
    def _pieces(starts: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        counts = -(-(stops - starts) // size)
        owner = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[owner] + nth * size
        return begin, np.minimum(begin + size, stops[owner])

    def offset(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries: prediction of the segment and stored correction."""
        places = self.firsts[texts] + ranks
        segment = np.searchsorted(self.starts, places, side="right") - 1
        guess = np.floor(self.slopes[segment] * (places - self.starts[segment])).astype(np.int64)
        return self.bases[segment] + guess + self.residuals[places]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all boundaries, the place of each text's first, and tokens per text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letter = ((codes | 32) - 97) < 26
    ends = np.ones(len(codes), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    tails = np.cumsum(sizes)
    ends[tails[sizes > 0] - 1] = True
    found = np.flatnonzero(ends) + 1
    begins = tails - sizes
    tokens = np.searchsorted(found, tails, side="right") - np.searchsorted(found, begins, side="right")
    firsts = np.cumsum(tokens + 1) - (tokens + 1)
    offsets = np.zeros(len(found) + len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), tokens)
    offsets[np.arange(len(found)) + owner + 1] = found - begins[owner]
    return offsets, firsts, tokens


def _draws(doc_id) -> list[int]:
    key = "1:" if doc_id is None else f"1:{doc_id}"
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(
    docs: DataFrame,
    plain_share: int = PLAIN_SHARE,
    spm_share: int = SPM_SHARE,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per document: doc_id, n tokens, form, prefix_chars, middle_chars, output text.

    `plain_share` percent of documents stay as they are, as do empty texts and texts that hold a
    mark; of the others `spm_share` percent begin with the suffix. Marks are written `<` name `>`,
    so that text beside a mark never makes another.
    """
    prefix_mark, suffix_mark, middle_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = [t or "" for t in batch.column("text").to_pylist()]
            all_ids = batch.column("doc_id").to_pylist()
            for part in text_groups(list(map(len, all_texts)), GROUP_CHARS):
                texts, ids = all_texts[part], all_ids[part]
                offsets, firsts, tokens = boundaries(texts)
                index = RankIndex(offsets, firsts)
                draws = np.array([_draws(i) for i in ids], np.int64).reshape(len(ids), 4)
                ranks = np.sort(draws[:, :2] % (tokens + 1)[:, None], axis=1)
                rows = np.arange(len(texts))
                first, second = index.offset(rows, ranks[:, 0]), index.offset(rows, ranks[:, 1])
                forms, outputs = [], []
                for text, a, b, (_, _, h3, h4) in zip(texts, first.tolist(), second.tolist(), draws.tolist()):
                    if not text or h3 % 100 >= 100 - plain_share or any(m in text for m in marks):
                        forms.append("plain")
                        outputs.append(text)
                    elif h4 % 100 < spm_share:
                        forms.append("spm")
                        outputs.append(f"{suffix_mark}{text[b:]}{prefix_mark}{text[:a]}{middle_mark}{text[a:b]}")
                    else:
                        forms.append("psm")
                        outputs.append(f"{prefix_mark}{text[:a]}{suffix_mark}{text[b:]}{middle_mark}{text[a:b]}")
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(texts)),
                        pa.array(tokens),
                        pa.array(forms),
                        pa.array(first, mask=plain),
                        pa.array(second - first, mask=plain),
                        pa.array(outputs, pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(
    output: Column | str = "output",
    form: Column | str = "form",
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> Column:
    """The text that `transformed` made `output` from."""
    whole, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    prefix_mark, suffix_mark, middle_mark = marks

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(whole, right, 1), left, -1)

    middle = F.substring_index(whole, middle_mark, -1)
    psm = F.concat(between(prefix_mark, suffix_mark), middle, between(suffix_mark, middle_mark))
    spm = F.concat(between(prefix_mark, middle_mark), middle, between(suffix_mark, prefix_mark))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(whole)


def op13_rank_index_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_rank_index_infilling": op13_rank_index_infilling}
SQL = {
    "op13_rank_index_infilling": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS r1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS r2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d3,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d4
  FROM cut
), parts AS (
  SELECT doc_id, text, n,
    array_to_string(units[1:least(r1, r2)], '') AS prefix,
    array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
    array_to_string(units[greatest(r1, r2) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
         WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
}
