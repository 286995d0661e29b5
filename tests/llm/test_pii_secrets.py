"""Secrets in either case."""

import re

from textloom.llm import pii

LOWER = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"


def test_upper_case_secret(spark):
    mixed = LOWER[:20] + LOWER[20:].upper()
    rows = [(1, f'token = "{LOWER}"'), (2, f'TOKEN = "{LOWER.upper()}"'), (3, f"key {mixed}.")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), told="entities").collect()}
    assert all([e.type for e in r.entities] == ["secret"] for r in out.values())
    new = {i: re.search("[0-9A-Fa-f]{32,}", r.text)[0] for i, r in out.items()}
    assert new[1] == pii.surrogate("secret", LOWER)[0] != LOWER
    assert new[2] == new[1].upper()
    assert new[3].lower() == new[1]
