"""Merkle manifest against a plain tree in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tractlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, root string, path string, g int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    doc_id, text, lang, source, n_chars = row[:5]
    count = None if n_chars is None else n_chars + add
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, count, text)]
    return digest(*shown)


def tree(hashes):
    """The root and, per leaf, its siblings with their side."""
    at = list(range(len(hashes)))
    paths = [[] for _ in hashes]
    while len(hashes) > 1:
        for i, p in enumerate(at):
            paths[i].append((hashes[p ^ 1] if p ^ 1 < len(hashes) else "", p % 2 == 1))
        hashes = [digest(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
        at = [p // 2 for p in at]
    return hashes[0] if hashes else None, paths


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inner = [], {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, inner[g] = tree([leaf_of(r) for r in groups[g]])
        subroots.append(root)
    root, outer = tree(subroots)
    found = []
    for k, g in enumerate(order):
        for row, path in zip(groups[g], inner[g]):
            path = path + outer[k]
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf_of(row, int(struck))
            for other, left in path:
                h = digest(other, h) if left else digest(h, other)
            proof = digest(*[other for other, _ in path])
            found.append((row[0], leaf_of(row), subroots[k], root, proof, h, h == root))
    return sorted(found, key=repr)


def run(spark, folder):
    got = merkle.op12_nested_rollup_manifest(spark, folder).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in got), key=repr)


def row(i, text="t", lang="en", source="s", n=1):
    return (i, text, lang, source, n, 1, "clash", "clash", 1)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 300])
def test_trees_of_any_size(spark, stored, tmp_path, size):
    rows = [row(i * 7 % size, f"text {i}", ["en", "é", None, "de", ""][i % 5], None if i % 4 else "src", None if i % 9 == 0 else i) for i in range(size)]
    stored(rows, SCHEMA)
    assert run(spark, str(tmp_path)) == plain(rows)


def test_one_language_over_several_blocks(spark, stored, tmp_path):
    rows = [row(i, f"{i}") for i in range(merkle.BLOCK * 2 + 5)] + [row(3, lang="fr")]
    rows += [(None, None, None, None, None, None, None, None, None)] * 2 + [row(5, "x" * 300_000, "fr")]
    stored(rows, SCHEMA)
    got = run(spark, str(tmp_path))
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_copies_of_one_row_are_cut_into_blocks(spark, stored, tmp_path):
    rows = [row(7, "copy")] * (merkle.BLOCK + 900) + [row(i, "other") for i in range(40)]
    stored(rows, SCHEMA)
    assert run(spark, str(tmp_path)) == plain(rows)


def test_no_rows(spark, stored, tmp_path):
    stored([], SCHEMA)
    assert run(spark, str(tmp_path)) == []
