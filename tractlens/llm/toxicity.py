"""Operator 11: toxicity from misspelled terms of a learned lexicon and the windows around them.

The lexicon is learned: words and word beginnings whose share among toxic training texts is far above
that among the others (log-likelihood ratio), longest and strongest first. Levenshtein automata of
the words of a text, intersected with the trie of the lexicon (`automaton`), find terms at up to two
edits. Every match is looked at in its window: inside quotation marks or after a reporting word it
is a mention, otherwise a use; other matches, direct address and shouting beside it are counted. A
logistic regression on these counts gives the score of the text.

Fitting reads labelled rows only, at most `SAMPLE` ids in the order of a hash (a stated bound); copies
and near copies among them count once, by equal minima of shingle hashes. The regression is fitted on
counts made with a lexicon of the other half, since a lexicon fits its own texts too well. It is held
near fixed starting weights, so that few labels, or kinds of windows that the labels lack, do no harm.
Counts and scores cover every whole text.

Defined cases: a null or empty text has no match and gets the score of an empty text; a null id is
scored, never learned from; repeated labels of an id count once, by their mean, repeated rows of an id
by their smallest text; without toxic labels the lexicon is empty and all scores are alike. Words are
separated by white space; in text without spaces only the beginning of each run is searched.
Columns of the input keep their names but for a clash with the score's name, which the caller chooses.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.llm.automaton import LexiconAutomaton
from tractlens.llm.common import held_out, process_cache, settled, table

SAMPLE = 20_000
CANDIDATES = 30_000
LEXICON = 3_000
LEAST_TEXTS, LEAST_RATIO, LEAST_FIT = 3, 4.0, 15.0
SHORTEST, LONGEST = 3, 12
WINDOW = 10
QUOTE_SPAN = 40
THRESHOLD = 0.5

# fixed values: marks and common words of the four languages of the tables
_OPENS, _CLOSES = "\"'“„«‹‘‚", "\"'”“»›’‘"
_EDGES = "\"'“”„«»‹›‘’‚()[]{}<>.,;:!?…*#$%&|_-–—~`^+=/\\"
_DRAWN_OUT = re.compile(r"(.)\1{2,}")
_EVIDENCE = (1.0, 0.8, 0.4, 0.2)
_REPORTS = frozenset(
    "said says say wrote writes called calls quote quoted quotes quoting word words term reported "
    "sagte sagt schrieb nannte zitat zitierte wort dit disait écrit appelé mot citation "
    "dijo dice escribió llamó palabra cita".split()
)
_ADDRESS = frozenset("you your you're youre u du dich dir dein ihr euch tu te toi ton vous votre tú ti usted tus vosotros".split())

FEATURES = (
    "uses disguised near_misses far_misses mentions reported crowd share different strength addressed shouted two three"
).split()
# weights that the regression starts from and is held near to
START = np.array([0.5, 0.0, 0.2, 0.1, 0.2, -0.2, 0.3, 0.3, 0.5, 0.5, 0.2, 0.2, 1.5, 1.0])
START_BASE = -3.0


def stripped(word: str) -> str:
    return word.strip(_EDGES)


def _quoted_spans(words: Sequence[str]) -> list[tuple[int, int]]:
    """Runs of at most QUOTE_SPAN words between an opening and a closing mark."""
    spans, begin = [], None
    for i, word in enumerate(words):
        if word[0] in _OPENS and begin is None:
            begin = i
        if begin is not None and i - begin > QUOTE_SPAN:
            begin = i if word[0] in _OPENS else None
        if begin is not None and len(word) > 1 and word.rstrip(".,;:!?)")[-1:] in tuple(_CLOSES):
            spans.append((begin, i))
            begin = None
    return spans


class Reader:
    """Counts of one lexicon in texts; words are matched once while they are remembered."""

    def __init__(self, terms: Sequence[tuple[str, float]], capacity: int = 400_000):
        self.automaton = LexiconAutomaton([t for t, _ in terms])
        self.strengths = [s for _, s in terms]
        self.capacity = capacity
        self.known: dict[str, tuple[int, int] | None] = {}

    def match(self, word: str) -> tuple[int, int] | None:
        """Kind of match and the term's number.

        Kinds: 0 exact, 1 disguised (drawn-out letters, or edits in a word with digits or symbols
        inside), 2 one edit, 3 more edits or a misspelled beginning.
        """
        if len(self.known) >= self.capacity:
            self.known.clear()
        plain = stripped(word.lower())
        short = _DRAWN_OUT.sub(r"\1", plain)
        found, kind = self.automaton.nearest(short), None
        if found is not None:
            edits, term, whole = found
            disguised = len(short) < len(plain) or (edits > 0 and whole and not short.isalpha())
            kind = (1 if disguised else 0 if edits == 0 else 2 if edits == 1 and whole else 3), term
        self.known[word] = kind
        return kind

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, kind, term) of all matches."""
        known, found = self.known, []
        for place, word in enumerate(words):
            try:
                match = known[word]
            except KeyError:
                match = self.match(word)
            if match is not None:
                found.append((place, *match))
        return found

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        hits = self.hits(words)
        if not hits:
            return [0.0] * len(FEATURES)
        spans = _quoted_spans(words)
        kinds, mentions, reported, addressed, shouted = [0, 0, 0, 0], 0, 0, 0, 0
        crowd, strength, different, first = 0, 0.0, set(), 0
        for n, (place, kind, term) in enumerate(hits):
            around = [stripped(w.lower()) for w in words[max(0, place - WINDOW) : place + WINDOW + 1]]
            before = around[: min(place, WINDOW)]
            told = not _REPORTS.isdisjoint(before)
            reported += told
            if any(a <= place <= b for a, b in spans):
                mentions += 1
                continue
            kinds[kind] += 1
            while hits[first][0] < place - WINDOW:
                first += 1
            crowd = max(crowd, n - first)
            strength += self.strengths[term] * _EVIDENCE[kind]
            different.add(words[place].lower())
            addressed += not _ADDRESS.isdisjoint(around)
            shouted += words[place].isupper() or words[place].endswith("!")
        uses = kinds[0] + _EVIDENCE[1] * kinds[1]
        logs = np.log1p([uses, *kinds[1:], mentions, reported, crowd])
        share = 10 * np.sqrt(sum(kinds) / len(words))
        rest = np.log1p([len(different), strength, addressed, shouted])
        return [*logs, share, *rest, float(len(different) >= 2), float(len(different) >= 3)]


@dataclass
class Model:
    terms: list[tuple[str, float]]
    base: float
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + x @ self.weights, -30, 30)))


def fitted_weights(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 30) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, held near the starting weights."""
    wide = np.hstack([np.ones((len(x), 1)), x.reshape(len(x), len(FEATURES))])
    start = np.append(START_BASE, START)
    beta, hold = start.copy(), np.full(len(start), ridge)
    hold[0] = 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(wide @ beta, -30, 30)))
        slope = wide.T @ (p - y) + hold * (beta - start)
        curve = (wide * (p * (1 - p))[:, None]).T @ wide + np.diag(hold)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return float(beta[0]), beta[1:]


def _minima(text: str | None) -> list[int]:
    """Three minima of hashes of five-word runs; near copies agree in most."""
    words = (text or "").lower().split()
    codes = np.array([zlib.crc32(w.encode()) for w in words] or [0], np.uint64)
    codes = np.concatenate([codes, np.zeros(max(0, 5 - len(codes)), np.uint64)])
    mixed = np.zeros(len(codes) - 4, np.uint64)
    for k in range(5):
        mixed = (mixed ^ codes[k : len(codes) - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    factors = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
    return [int((mixed * np.uint64(f) >> np.uint64(1)).min()) for f in factors]


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Training rows: doc_id, text, toxic, half; one for each id and each group of near copies."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(0, 5))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` ids are broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.array([_minima(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(minima[:, i]) for i in range(3)]], [*batch.schema.names, "m0", "m1", "m2"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = settled(single.mapInArrow(run, f"doc_id {id_type}, text string, toxic boolean, m0 long, m1 long, m2 long"))
    kept = rows.select("doc_id", "m0", "m1", "m2")
    for m in ("m0", "m1", "m2"):
        kept = kept.groupBy(m).agg(F.min(F.struct("doc_id", "m0", "m1", "m2")).alias("one")).select("one.*")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    return settled(rows.join(kept.select("doc_id"), "doc_id").select("doc_id", "text", "toxic", half.alias("half")))


def _fit(a: Column, b: Column, all_a: Column, all_b: Column) -> Column:
    """Signed log-likelihood ratio of a term in `a` of `all_a` toxic and `b` of `all_b` other texts."""

    def part(seen: Column, share: Column, of: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (share * of))).otherwise(0.0)

    share = (a + b) / (all_a + all_b)
    ratio = 2 * (
        part(a, share, all_a) + part(b, share, all_b) + part(all_a - a, 1 - share, all_a) + part(all_b - b, 1 - share, all_b)
    )
    strong = (a >= LEAST_TEXTS) & (a * all_b > LEAST_RATIO * b * all_a)
    return F.when(strong, ratio).otherwise(0.0)


def term_counts(sample: DataFrame) -> DataFrame:
    """Texts of both kinds and halves that hold a term: a word or a beginning of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            terms, places = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(places, pa.int32()), pa.array(counts.values(), pa.int64())],
                ["term", "place", "n"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")))
            for text, toxic, half in rows:
                place = 2 * half + toxic
                words = {stripped(w) for w in (text or "").lower().split()}
                terms = {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
                counts.update((t, place) for t in terms)
                counts["", place] += 1
                if len(counts) > 1_000_000:
                    yield flushed()
                    counts.clear()
        yield flushed()

    places = [F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)]
    return sample.mapInArrow(run, "term string, place int, n long").groupBy("term").agg(*places)


def _chosen(rows: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The strongest terms, the longest of equal ones, none the beginning of another."""
    taken: dict[str, float] = {}
    beginnings: set[str] = set()
    for term, fit in sorted(rows, key=lambda r: (-r[1], -len(r[0]), r[0])):
        if fit < LEAST_FIT or len(taken) == LEXICON:
            break
        if term in beginnings or any(term[:k] in taken for k in range(SHORTEST, len(term) + 1)):
            continue
        taken[term] = fit
        beginnings.update(term[:k] for k in range(SHORTEST, len(term)))
    return [(t, float(np.log1p(f / LEAST_FIT))) for t, f in taken.items()]


def lexicons(sample: DataFrame) -> list[list[tuple[str, float]]]:
    """Terms with their strength: learned without half 0, without half 1, and from both."""
    counts = settled(term_counts(sample))
    totals = counts.where(F.col("term") == "").first()
    if totals is None:
        return [[], [], []]
    n = [F.col(f"n{i}") for i in range(4)]
    t = [F.lit(totals[f"n{i}"]) for i in range(4)]
    fits = [
        _fit(n[3], n[2], t[3], t[2]),
        _fit(n[1], n[0], t[1], t[0]),
        _fit(n[1] + n[3], n[0] + n[2], t[1] + t[3], t[0] + t[2]),
    ]
    scored_terms = counts.where(F.col("term") != "").select("term", *[f.alias(f"f{i}") for i, f in enumerate(fits)])
    best = F.greatest("f0", "f1", "f2")
    # the lexicon holds at most LEXICON terms, found among at most CANDIDATES that reach the driver
    rows = scored_terms.where(best >= LEAST_FIT).orderBy(best.desc(), "term").limit(CANDIDATES).collect()
    return [_chosen([(r.term, r[f"f{i}"]) for r in rows]) for i in range(3)]


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns lexicon and weights from labelled rows that are not held out."""
    rows = sampled(docs, labels, sample)
    halves = lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(terms) for terms in halves[:2]]
        for batch in batches:
            x = [readers[h].features(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    # at most `sample` rows of counts
    got = rows.mapInArrow(run, "toxic boolean, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return Model(halves[2], *fitted_weights(x, got["toxic"].to_numpy(float)))


def _reader(model: Model) -> Reader:
    """The reader of a worker for a model, kept from task to task."""
    cache = process_cache()
    terms, reader = cache.get("toxicity", (None, None))
    if terms != model.terms:
        reader = Reader(model.terms)
        cache["toxicity"] = model.terms, reader
    return reader


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of `docs` and the toxicity of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        for batch in batches:
            x = np.array([reader.features(t) for t in batch.column("text").to_pylist()], float)
            scores = shared.value.score(x.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op11_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    result = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return result.select(
        "doc_id",
        held_out(0, 5).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op11_lexicon_automata": op11_lexicon_automata}
SQL: dict[str, str] = {}
