"""Fill-in-middle against a plain loop over regular-expression tokens."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractlens.llm import infilling

SCHEMA = "doc_id long, text string, n int, form string, output string"


def plain_loop(doc_id, text):
    """The contract, token by token."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ 9\n<é世😀", max_size=60), min_size=1, max_size=6))
def test_every_boundary_is_found_exactly(texts):
    offsets, firsts, tokens = infilling.boundaries(texts)
    index = infilling.RankIndex(offsets, firsts)
    for i, text in enumerate(texts):
        ends = [0] + [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        assert tokens[i] == len(ends) - 1
        assert index.offset(np.full(len(ends), i), np.arange(len(ends))).tolist() == ends


def test_segments_split_where_lines_fail():
    words = ["a" * (1 + 7000 * (i % 50 == 0)) for i in range(3000)]
    offsets, firsts, _ = infilling.boundaries([" ".join(words), "", "x"])
    index = infilling.RankIndex(offsets, firsts)
    assert len(index.starts) > 50
    assert index.offset(np.zeros(firsts[1], int), np.arange(firsts[1])).tolist() == offsets[: firsts[1]].tolist()
    straight, start, _ = infilling.boundaries(["ab " * 200_000])
    lines = infilling.RankIndex(straight, start)
    assert len(lines.starts) == -(-len(straight) // infilling.FIRST_SEGMENT)


@pytest.fixture
def rows():
    texts = [None, "", " ", "word", "don't stop", "naïve 世界😀 x", "a<P>b", "a < S>b <M", "tail <", "x" * 50_000, "a b\n" * 60_000]
    made = [(i, texts[i % len(texts)], i, "mine", "old") for i in range(220)]
    return made + [(None, "no id here", 1, None, None), (3, "word", 1, None, None), (3, "other words", 1, None, None)]


def test_forms_cuts_and_way_back(spark, stored, rows):
    docs = stored(rows, SCHEMA)
    made = infilling.transformed(docs).withColumn("back", infilling.restored())
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=repr)
    want = sorted(((i, *plain_loop(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_whole_query_and_empty_table(spark, stored):
    sf = "/root/testdata/sf0.001"
    docs = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        docs.setdefault(r.doc_id, r.text or "")
    got = infilling.op13_rank_index_infilling(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        n, form, _, _, output = plain_loop(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.output_sha256) == (n, form, hashlib.sha256(output.encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    nothing = infilling.transformed(stored([], SCHEMA)).select("*", F.length(infilling.restored()).alias("l"))
    assert nothing.count() == 0


def test_a_text_of_many_megabytes(spark, stored):
    text = "Some words, 世 and " * 1_000_000
    got = infilling.transformed(stored([(5, text)], "doc_id long, text string")).select("n", infilling.restored().alias("back")).first()
    assert got.n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text)) and got.back == text
