"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from tractlens.llm import (
    bpe,
    caps,
    fertility,
    gam,
    htmltext,
    infilling,
    linededup,
    merkle,
    minhash,
    mixing,
    packing,
    resharding,
    toxicity,
)

_MODULES = (
    packing, fertility, bpe, gam, resharding, minhash, caps, htmltext, linededup, mixing, toxicity, merkle, infilling,
)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
