"""Greedy removal over many tasks against the plain loop."""

import random

import pytest

from textloom.operators import chunking as C


def brute(rows, most):
    out, kept = set(), {}
    for d, i, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = {w for w in t.lower().split() if len(w) > 1}
        mine = kept.setdefault(d, [])
        if not s or all(len(s & o) <= most * len(s | o) for o in mine):
            out.add((d, i))
            if s:
                mine.append(s)
    return out


@pytest.mark.parametrize("leads", [0, 3])
def test_equal_to_the_plain_loop(spark, monkeypatch, leads):
    monkeypatch.setattr(C, "LEADS", leads)
    rng = random.Random(6)
    rows = []
    for d in ("a", "b", None):
        base = [[f"w{rng.randrange(40)}" for _ in range(20)] for _ in range(4)]
        for i in range(70):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(20)] = f"w{rng.randrange(60)}"
            rows.append((d, i, "" if i % 31 == 7 else " ".join(words)))
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index long, text string")
    for most in (0.6, 0.9):
        want = brute(rows, most)
        assert {(r.doc_id, r.chunk_index) for r in C.spread_greedy(chunks, most).collect()} == want
        assert 3 < len(want) < len(rows)


def test_large_documents_are_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "ONE_TASK", 50)
    rows = [("big", i, " ".join(f"t{i % 30}x{k}" for k in range(12)) + f" only{i % 60}") for i in range(400)] + [("small", i, "same words") for i in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index long, text string")
    got = {(r.doc_id, r.chunk_index) for r in C.drop_near_chunks(chunks, 0.8).collect()}
    assert got == brute(rows, 0.8) and len(got) == 31
