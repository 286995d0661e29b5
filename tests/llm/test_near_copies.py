"""Near copies in the pipeline against the exact Jaccard similarity of all pairs."""

import random

from textloom.llm import simhash


def sets(rows):
    out = {}
    for i, t in rows:
        w = t.split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows, least=0.8):
    """The ids that stay: the smallest of each component of the links."""
    found = sets(rows)
    ids = sorted(found)
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(found[i], found[j]) >= least:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def kept(spark, rows, **how):
    return {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def some(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_boilerplate_stays(spark):
    """300 shared shingles and 75 to 200 own ones: a Jaccard similarity of 0.6 to 0.67, where nothing may go."""
    rng = random.Random(1)
    shared = some(rng, 304)
    rows = [(i, " ".join(shared + some(rng, 75 + i % 4 * 8))) for i in range(300)]
    assert len(brute(rows)) == 300
    assert kept(spark, rows) == {i for i, _ in rows}


def test_close_to_the_threshold(spark):
    """Groups whose similarity lies on both sides of 0.8."""
    rng = random.Random(2)
    rows = []
    for g in range(60):
        base = some(rng, 200)
        for k in range(3):
            rows.append((3 * g + k, " ".join(base + some(rng, rng.choice([8, 16, 30, 44])))))
    got, want = kept(spark, rows), brute(rows)
    assert 60 < len(want) < 180
    assert got == want


def test_partner_behind_others(spark):
    """Copies of each other among many documents with one passage, which share keys with documents they are no copies of."""
    rng = random.Random(3)
    shared = some(rng, 304)
    rows = []
    for g in range(120):
        own = some(rng, 130)
        rows.append((g, " ".join(shared + own)))
        rows.append((1000 + (g * 37) % 120, " ".join(shared + own[:-30] + some(rng, 30))))
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) == 120
    assert kept(spark, rows) == want
    assert kept(spark, rows, block=7) == want  # keys and rare shingles cut into many blocks


def test_blocks_of_a_rare_shingle(spark):
    """Every two members of a shingle meet once, whatever the blocks."""
    rows = [(i, h, 9, 9, i % 4, b"") for h, m in ((1, 40), (2, 3), (3, 1)) for i in range(m)]
    found = spark.createDataFrame([*rows, (1, 4, 9, 9, 1, b""), (5, 4, 9, 9, 1, b"")], "id long, h long, n long, left long, component long, fp binary")
    for size in (3, 512):
        met = []
        for r in simhash.rare_blocks(found, size).collect():
            assert len(r.members) <= 6 * size
            met += [(a.id, b.id) for k, a in enumerate(r.members) for b in r.members[k + 1 :] if r.alone or a.block != b.block]
        assert sorted(met) == sorted([(i, j) for m in (40, 3) for j in range(m) for i in range(j)])


def test_lone_pairs(spark):
    """Two documents a group, 0.80 to 0.84 alike: no third one helps to find them."""
    rng = random.Random(4)
    rows = []
    for g in range(400):
        base = some(rng, 300)
        rows += [(2 * g, " ".join(base + some(rng, 28 + g % 8))), (2 * g + 1, " ".join(base + some(rng, 28 + g % 8)))]
    found = sets(rows)
    assert all(0.8 <= jaccard(found[2 * g], found[2 * g + 1]) < 0.85 for g in range(400))
    assert len(kept(spark, rows)) <= 402  # 0.0004 of the pairs may share no key
