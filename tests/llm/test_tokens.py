"""Packing, tokeniser rules, encoding and language-model scores against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractlens.llm.common import settled
from tractlens.llm import bpe, common, fertility, hilbert, mixing, packing, wordblocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "",
    None,
    " ",
    "  two  spaces \n\n and\ttabs \x0b\x0c",
    "\x1c unit\x1cseparators \x85 and   wide　spaces ",
    "don't we'll it's I'D 12 345 x9 <|endoftext|> !!! ??",
    "a\0b \0 c",
    "日本語 の テキスト 😀 emoji ñandú über",
    "word " * 300,
    "x" * 5000,
    "end of line\nstart \n trailing space \n",
    "a b",
    " lead",
    "trail ",
]


@pytest.fixture
def docs(stored):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "en", "s", 0), (None, "no id here", "en", "s", 0), (8, "another text for id eight", "en", "s", 0)]
    return stored(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_units_join_to_the_text_and_keep_the_ids():
    encoding = fertility.rank_encoding(fertility.rank_path())
    for text in ODD[2:]:
        cut = common.units(text)
        assert "".join(cut) == text
        assert [i for u in cut for i in encoding.encode_ordinary(u)] == encoding.encode_ordinary(text)


def test_hilbert_keys_visit_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="a'sé1 \n\t\u3000<|endoftext|>", max_size=80))
def test_merge_ranks_give_the_ids_of_the_library(text):
    from tokenizers import Tokenizer

    cache = packing.process_cache()
    if "plain" not in cache:
        cache["plain"] = Tokenizer.from_file(packing.byte_bpe_path())
        cache["plain"].encode_special_tokens = True
    assert packing._ranked(packing.byte_bpe_path()) is not None if "checked" not in cache else True
    cache["checked"] = True
    encode, _ = packing._encoder(packing.byte_bpe_path())
    assert encode(text).tolist() == cache["plain"].encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_keeps_every_id(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    tokenizer.encode_special_tokens = True
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pieces = settled(packing.packed(docs, packing.byte_bpe_path(), length=64))
    found = pieces.toPandas()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter()
    for row in docs.collect():
        want[row.doc_id, tuple([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1])] += 1
    by_place = found.sort_values(["sequence_id", "offset"])
    stream = np.concatenate([np.frombuffer(b, "<u4") for b in by_place.ids])
    assert (by_place.length.cumsum() - by_place.length == by_place.sequence_id * 64 + by_place.offset).all()
    assert sum(len(k[1]) * n for k, n in want.items()) == len(stream)
    got, at = Counter(), 0
    while at < len(by_place):
        first = by_place.iloc[at]
        assert first.start == 0
        ids, total = [], 0
        while total < first.doc_tokens:
            ids += np.frombuffer(by_place.iloc[at].ids, "<u4").tolist()
            total += by_place.iloc[at].length
            at += 1
        got[None if np.isnan(first.doc_id) else int(first.doc_id), tuple(ids)] += 1
    assert got == want
    whole = packing.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 64 for r in whole) and len(whole) == -(-len(stream) // 64)
    assert packing.packed(empty, packing.byte_bpe_path()).count() == 0


def test_base_counts_match_a_plain_version(docs):
    rows = fertility.measured(docs, fertility.rank_path(), fertility.piece_path()).collect()
    for row in rows:
        text = row.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == len(hit)
        assert row.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_bands_reject_an_outlier_and_keep_the_rest(spark, stored, empty):
    random = np.random.default_rng(3)
    words = ["the", "of", "river", "station", "morning", "paper", "because", "under", "market", "window"]
    texts = [" ".join(random.choice(words, 120)) + f" {k} end" for k in range(60)]
    strange = " ".join("ЖЩ" + "".join(map(chr, random.integers(0x4E00, 0x9000, 6))) for _ in range(120))
    docs = stored([(i, t, "en", "s", 0) for i, t in enumerate([*texts, strange])], SCHEMA)
    rows = fertility.measured(docs, fertility.rank_path(), fertility.piece_path()).withColumn("band", F.col("lang"))
    kept = {r.doc_id: r.kept for r in fertility.judged(rows, fertility.bands(rows)).collect()}
    passed = {r.doc_id for r in rows.collect() if not r.base_failed}
    assert not kept[60]
    assert all(kept[i] for i in passed - {60})
    none = fertility.measured(empty, fertility.rank_path(), fertility.piece_path())
    assert fertility.judged(none, fertility.bands(none)).count() == 0


def measured_rows(spark, groups):
    """Measured documents of (count, language, source, words, characters per token)."""
    rows = [
        (k, language, "latin", source, words, 2 * words, False, round(chars + 0.004 * (j % 9 - 4), 3), 0.0, 0.7)
        for k, (j, language, source, words, chars) in enumerate((j, *g[1:]) for g in groups for j in range(g[0]))
    ]
    names = "doc_id long, language string, script string, source string, n_words long, n_tokens long, base_failed boolean"
    return spark.createDataFrame(rows, names + ", chars_per_token double, byte_share double, entropy double")


def test_a_document_alone_in_its_length_is_no_judge_of_itself(spark, stored):
    random = np.random.default_rng(5)
    words = ["the", "of", "river", "station", "morning", "paper", "because", "under", "market", "window"]
    texts = [" ".join(random.choice(words, 120)) + f" {k} end" for k in range(60)]
    han = " ".join("".join(map(chr, random.integers(0x4E00, 0x9000, 6))) for _ in range(3000))
    docs = stored([(i, t, "en", "s", 0) for i, t in enumerate([*texts, han])], SCHEMA)
    rows = fertility.measured(docs, fertility.rank_path(), fertility.piece_path())
    kept = {r.doc_id: r.kept for r in fertility.judged(rows, fertility.bands(rows)).collect()}
    assert not kept[60]
    assert all(kept[r.doc_id] for r in rows.collect() if not r.base_failed and r.doc_id != 60)
    # a rare language is held against its script, a rare length against its language
    rows = measured_rows(spark, [(60, "en", "s", 100, 2.3), (1, "xx", "s", 100, 1.5), (1, "xx", "s", 100, 2.3), (1, "en", "s", 5000, 1.5), (1, "en", "s", 5000, 2.3)])
    assert [r.kept for r in fertility.judged(rows, fertility.bands(rows)).orderBy("doc_id").collect()][60:] == [False, True, False, True]


def test_a_third_of_bad_documents_sets_no_band(spark):
    good = [(10, "en", f"s{k}", 100, 2.3) for k in range(8)]
    rows = measured_rows(spark, [*good, (40, "en", "hot", 100, 1.6)])
    kept = [r.kept for r in fertility.judged(rows, fertility.bands(rows)).orderBy("doc_id").collect()]
    assert all(kept[:80]) and not any(kept[80:])
    # a source with most of the documents
    rows = measured_rows(spark, [*good, (120, "en", "hot", 100, 1.6)])
    kept = [r.kept for r in fertility.judged(rows, fertility.bands(rows)).orderBy("doc_id").collect()]
    assert all(kept[:80]) and not any(kept[80:])
    # nothing else to compare with
    rows = measured_rows(spark, [(40, "en", "hot", 100, 1.2)])
    assert not any(r.kept for r in fertility.judged(rows, fertility.bands(rows)).collect())


def test_encoding_equals_the_library_and_decodes(docs, empty):
    encoding = fertility.rank_encoding(fertility.rank_path())
    rows = bpe.decoded(bpe.encoded(docs, fertility.rank_path(), buckets=7), fertility.rank_path()).collect()
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<i4").tolist()), bytes(r.bytes)) for r in rows)
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert bpe.encoded(empty, fertility.rank_path()).count() == 0


def test_encoding_of_many_blocks(stored, monkeypatch):
    monkeypatch.setattr(wordblocks, "BLOCK_CHARS", 50)
    docs = stored([(i, f"text number {i} with  words " * (i % 5), "en", "s", 0) for i in range(40)], SCHEMA)
    encoding = fertility.rank_encoding(fertility.rank_path())
    rows = bpe.encoded(docs, fertility.rank_path(), buckets=3).collect()
    got = {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in rows}
    assert got == {r.doc_id: encoding.encode_ordinary(r.text) for r in docs.collect()}


def plain_beginnings(words, counts):
    """Training tokens per (beginning, bits so far) and those with a one next."""
    total, ones = defaultdict(int), defaultdict(int)
    for word, count in zip(words, counts):
        spelled = word + b" "
        for j, byte in enumerate(spelled):
            for bit in range(8):
                key = spelled[:j], bit, byte >> (8 - bit)
                total[key] += count
                ones[key] += count * (byte >> (7 - bit) & 1)
    return total, ones


def test_counts_of_beginnings_match_a_plain_version():
    words = [b"theatre", b"theatres", b"theatrical", b"thea", b"", b"of", b"theat\x01", b"theatre\xff"]
    counts = np.array([3, 1, 2, 5, 9, 4, 1, 1])
    spelled = mixing.Spelled(words, counts)
    total, ones = plain_beginnings(words, counts)
    start = 0
    for word, length in zip(spelled.words, spelled.lengths):
        for j in range(mixing.HEAD, length):
            for bit in range(8):
                key = (word + b" ")[:j], bit, (word + b" ")[j] >> (8 - bit)
                assert spelled.total[start + j, bit] == total[key] and spelled.ones[start + j, bit] == ones[key]
        start += length


def test_counts_of_long_beginnings_match_a_plain_version():
    stem = "ภาษาไทยไม่มีช่องว่าง".encode()
    words = [stem + b"a" * 40, stem + b"a" * 40 + b"b", stem + b"c", stem, b"x" * 300, b"alone" * 20]
    counts = np.array([3, 1, 2, 5, 4, 7])
    spelled = mixing.Spelled(words, counts)
    total, ones = plain_beginnings(words, counts)
    start = 0
    for word, length in zip(spelled.words, spelled.lengths):
        for j in range(mixing.HEAD, length):
            for bit in range(8):
                key = (word + b" ")[:j], bit, (word + b" ")[j] >> (8 - bit)
                assert spelled.total[start + j, bit] == total[key] and spelled.ones[start + j, bit] == ones[key]
        start += length


def test_token_probabilities_add_up_to_at_most_one():
    words = [b"a", b"ab", b"abc", b"b", b""]
    counts = np.array([5, 3, 1, 2, 4])
    tables = np.zeros((2, mixing.ORDERS, 1 << mixing.SLOT_BITS), np.float32)
    everything = [b"", *[bytes([b]) for b in range(256) if b != 32]]
    spelled = mixing.Spelled([*words, *[w for w in everything if w not in words]], np.array([*counts, *[0] * (len(set(everything) - set(words)))]))
    empty_map = np.tile(np.linspace(-mixing.REACH, mixing.REACH, mixing.CELLS), (mixing.GATES // 8, 1)).astype(np.float32)
    logs = mixing.spelled_log10(spelled, tables, mixing.first_weights(), empty_map)
    assert 0 < (10**logs).sum() <= 1


def test_scores_of_texts(docs, empty, stored):
    train = docs.withColumn("train", (~common.held_out(2, 7)).cast("long"))
    rows = mixing.scored(train).collect()
    seen = Counter()
    for r in train.collect():
        if r.train:
            seen.update([*(r.text or "").encode().lower().split(), b""])
    tokens, types = sum(seen.values()), len(seen)
    want, got = defaultdict(list), defaultdict(list)
    for r in train.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        base = sum(np.log10((seen[w] + 1) / (tokens + types + 1)) for w in words)
        want[r.doc_id].append((len(words), sum(seen[w] > 0 for w in words), round(base, 6)))
    for r in rows:
        got[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
        assert r.train_tokens == tokens and r.score < 0
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}
    assert mixing.scored(empty.withColumn("train", common.held_out(2, 7).cast("long"))).count() == 0


def test_a_learned_text_is_likelier_than_a_strange_one(stored):
    rows = [(i, "the river runs under the old bridge of the town " * 20, "en", "s", 0) for i in range(40)]
    odd = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    more = next(i for i in range(odd + 1, 300) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows += [(odd, "the old river runs under the town", "en", "s", 0), (more, "qzx vvkpw jjq xxw qqqkz bzzw zzt", "en", "s", 0)]
    docs = stored(rows, SCHEMA).withColumn("train", (~common.held_out(2, 7)).cast("long"))
    score = {r.doc_id: r.score for r in mixing.scored(docs).collect()}
    assert score[odd] > score[more]


def test_scores_follow_the_order_of_words_and_bits_per_byte(stored):
    words = "river runs under old bridge town where boats wait until morning comes".split()
    odd = [i for i in range(100, 300) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, " ".join(words * 5), "en", "s", 0) for i in range(40)]
    rows += [(odd[0], " ".join(words), "en", "s", 0), (odd[1], " ".join(words[::-1]), "en", "s", 0)]
    docs = stored(rows, SCHEMA).withColumn("train", (~common.held_out(2, 7)).cast("long"))
    got = {r.doc_id: r for r in mixing.scored(docs).collect()}
    right, wrong = (got[i] for i in odd)
    assert right.n_tokens == wrong.n_tokens and abs(right.base_score - wrong.base_score) < 1e-9
    assert right.score > wrong.score + 5
    for r in (right, wrong):
        assert r.n_bytes == len(" ".join(words)) + 2
        assert abs(r.bits_per_byte + r.score * np.log2(10) / r.n_bytes) < 1e-9


def test_sequence_counts_match_a_plain_version(stored, monkeypatch):
    monkeypatch.setattr(wordblocks, "BLOCK_CHARS", 40)
    texts = ["a b a b c", "a b", "", "c c c a b a", "b a b c c a"]
    docs = stored([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("train", (F.col("doc_id") != 3).cast("long"))
    want = Counter()
    for i, t in enumerate(texts):
        words = mixing.tokens_of(t)
        two, three = mixing.sequence_keys(mixing.word_hashes(words), np.array([len(words)]))
        for key in [*two, *three[1:]]:
            want[int(key)] += i != 3
    rows = mixing.sequences(docs, 3, "train").toArrow()
    got = {}
    for bucket in set(rows.column("bucket").to_pylist()):
        group = rows.filter(pc.equal(rows.column("bucket"), bucket))
        for keys, counts in zip(group.column("keys").to_pylist(), mixing.summed_sequences(group).column("counts").to_pylist()):
            for key, count in zip(np.cumsum(mixing.unpack_numbers(keys), dtype=np.uint64).tolist(), mixing.unpack_numbers(counts).tolist()):
                assert got.setdefault(key, count) == count
    assert got == dict(want)


def test_scoring_leaves_no_shuffle_files_and_the_setting_as_it_was(docs, spark):
    def shuffle_files():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in kept.mkString("\n").split("\n") if "shuffle_" in n}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(), spark.conf.get(name, None)
    mixing.scored(docs.withColumn("train", (~common.held_out(2, 7)).cast("long")))
    assert not shuffle_files() - before and spark.conf.get(name, None) == setting


def test_sums_in_context_over_runs_equal_one_logarithm_a_token():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 40, 12, 13, 300, 2])
    n, begins = sizes.sum(), np.cumsum(sizes) - sizes
    logs, pair = -8 * rng.random(n), rng.integers(0, 3, n).astype(float)
    logs[3], pair[3] = -700, 0  # a long new word
    triple, one, two = np.minimum(pair, rng.integers(0, 2, n)), pair + rng.integers(0, 10**9, n), rng.integers(2, 9, n).astype(float)
    got, k = mixing.in_context(logs, pair, one, triple, two, begins), 0
    for a in mixing.CONCENTRATIONS:
        for b in mixing.CONCENTRATIONS:
            new = logs + np.log10(a / (one + a)) + np.log10(b) - np.log10(two + b)
            known = np.log10((triple + b * (pair + a * 10.0**logs) / (one + a)) / (two + b), where=pair > 0, out=new.copy())
            assert np.allclose(got[k], np.add.reduceat(np.where(pair > 0, known, new), begins), rtol=1e-12)
            k += 1


def test_scoring_cuts_every_text_into_tokens_once(docs, spark, monkeypatch):
    cut = spark.sparkContext.accumulator(0)

    def counted(text):
        cut.add(1)
        return [*text.encode("utf-8", "replace").lower().split(), b""]

    monkeypatch.setattr(mixing, "tokens_of", counted)
    mixing.scored(docs.withColumn("train", (~common.held_out(2, 7)).cast("long"))).collect()
    assert cut.value == docs.count()


def test_steps_of_keys_travel_in_fewer_bytes_than_they_fill():
    keys = np.sort(np.random.default_rng(2).integers(1 << 47, 1 << 48, 200_000, dtype=np.uint64))
    steps = np.diff(keys, prepend=np.uint64(0))
    for plain in range(9):
        assert (wordblocks.unpack_numbers(wordblocks.pack_numbers(steps, plain)) == steps).all()
    assert len(wordblocks.unpack_numbers(wordblocks.pack_numbers(steps[:0], 3))) == 0
    assert len(wordblocks.pack_numbers(steps, plain=3)) < 4.5 * len(steps)
