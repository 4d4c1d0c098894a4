"""Helpers of these tests."""

from __future__ import annotations

import re

import duckdb
import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def order_of(ident):
    """Rows without id come last."""
    return float("inf") if ident is None else ident


def canonical_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


def duck_rows(rows, sql: str, columns: str) -> list[tuple]:
    con = duckdb.connect()
    frame = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame = frame.astype({"doc_id": "Int64", "n_chars": "Int64", "text": "string", "lang": "string", "source": "string"})
    con.register("documents", frame)
    return con.execute(f"SELECT {columns} FROM ({sql})").fetchall()
