"""Transcripts of a Y, of bubbles, of a ring and of seeds without reads between."""

import random

import pytest

from strandlake.operators import graph, transcripts
from tests.test_sequence import dna, rc, table

K = 15


def reads_of(seq, size=60, copies=1, turn=False):
    out = [seq[i : i + size] for i in range(0, len(seq) - size + 1)] * copies
    return [rc(x) if turn and i % 2 else x for i, x in enumerate(out)]


def one_strand(*seqs):
    return {min(x, rc(x)) for x in seqs}


Y = [dna(900 + i, 150) for i in range(3)]
BUBBLE = [dna(910 + i, n) for i, n in enumerate((120, 50, 70, 120))]
TWO = [dna(920 + i, n) for i, n in enumerate((100, 30, 30, 25, 30, 30, 100))]
FAR = [dna(960 + i, n) for i, n in enumerate((100, 30, 30, 150, 30, 30, 100))]
RING = dna(930, 120)
TWICE = [dna(940 + i, n) for i, n in enumerate((100, 25, 60, 100))]


@pytest.fixture(scope="module")
def made(spark):
    """Splice graphs that share nothing, assembled together: seq -> row."""
    a, b, c = Y
    reads = reads_of(a + b, turn=True) + reads_of(a + c, copies=2, turn=True)
    a, x, y, d = BUBBLE
    reads += reads_of(a + x + d) + reads_of(a + y + d)
    a, x, y, d, u, v, z = TWO  # reads of 60 run from one bubble into the other
    reads += reads_of(a + x + d + v + z) + reads_of(a + y + d + u + z, copies=2)
    a, x, y, d, u, v, z = FAR  # no read does
    reads += reads_of(a + x + d + u + z, copies=2) + reads_of(a + y + d + v + z)
    reads += reads_of(RING + RING[:70])
    a, r, b, c = TWICE
    reads += reads_of(a + r + b + r + c)
    held = table(spark, *reads)
    return {r.seq: r for r in transcripts.assemble(graph.build(held, K), held, K).collect()}, len(reads)


def about(made, *parts):
    """The transcripts that hold any of parts on either strand."""
    return {s for s in made if any(p in s or p in rc(s) for p in parts)}


def test_a_y_gives_two_transcripts(made):
    made, total = made
    a, b, c = Y
    assert about(made, *Y) == one_strand(a + b, a + c)
    first, second = (made[min(x, rc(x))] for x in (a + b, a + c))
    assert first.component == second.component and first.n_paths == second.n_paths == 2
    assert first.reads + second.reads == pytest.approx(3 * 241)  # reads of 60 in 300 bases; those wholly in what both share count half for each
    assert first.reads < second.reads and first.support < second.support
    for r in (first, second):
        assert r.fpkm == pytest.approx(r.reads * 1e9 / (300 * total))


def test_a_bubble_gives_two_transcripts(made):
    a, x, y, d = BUBBLE
    assert about(made[0], *BUBBLE) == one_strand(a + x + d, a + y + d)


def test_reads_phase_two_bubbles(made):
    a, x, y, d, u, v, z = TWO
    assert about(made[0], *TWO) == one_strand(a + x + d + v + z, a + y + d + u + z)


def test_without_such_reads_weak_arms_go_with_weak_arms(made):
    a, x, y, d, u, v, z = FAR
    assert about(made[0], *FAR) == one_strand(a + x + d + u + z, a + y + d + v + z)


def test_rings_end_and_repeats_are_walked(made):
    ring = about(made[0], *(RING[i : i + 40] for i in range(0, 80, 10)))
    assert ring and all(len(s) < 3 * len(RING) for s in ring)
    a, r, b, c = TWICE
    assert one_strand(a + r + b + r + c) <= set(made[0])


def test_components_are_apart(made):
    homes = [{made[0][s].component for s in about(made[0], *parts)} for parts in (Y, BUBBLE, TWO, FAR, [TWICE[0]])]
    assert all(len(h) == 1 for h in homes) and len(set.union(*homes)) == 5


def test_seeds_grow_without_reads(spark):
    a, b, c = (dna(950 + i, 80) for i in range(3))
    parts = [a + b[:20], (a + b)[-80:], a[-30:] + c[:30]]
    edges = graph.build(table(spark, *(parts[:1] * 6 + parts[1:2] * 6 + parts[2:] * 3)), K)
    held = table(spark, a[:40])
    got = {r.seq for r in transcripts.assemble(edges, held, K).collect()}
    assert any(a + b in (s, rc(s)) for s in got)  # the better covered arm
    assert all(sum(x in s or x in rc(s) for s in got) == 1 for x in (a[:60], b[-50:], c[:30][-14:]))  # none in two transcripts
    apart = {r.seq for r in transcripts.assemble(edges, held, K, ratio=1.0).collect()}
    assert not any(a + b in (s, rc(s)) for s in apart)


def test_nothing_in_nothing_out(spark):
    held = table(spark, "ACG", "", None)
    assert transcripts.assemble(graph.build(held, K), held, K).count() == 0


def test_strongest_ways_equal_brute_force(spark):
    """Random splice graphs with cycles: the width of each weld's way is that of the best simple way from any beginning."""
    rnd = random.Random(3)
    welds = {}
    for g in range(3):
        for _ in range(14):
            u, v = rnd.sample(range(7), 2)
            welds[f"{g}p{u}", f"{g}p{v}"] = rnd.randint(4, 40)
    follow = [(u, v, w, min(n, m), False) for (u, v), n in welds.items() for (x, w), m in welds.items() if x == v]
    into = {(v, w) for _, v, w, _, _ in follow}
    best = {}
    todo = [((s,), n) for s, n in welds.items() if s not in into]
    begins = {s for s, n in welds.items() if s not in into}
    while todo:
        way, width = todo.pop()
        best[way[-1]] = max(best.get(way[-1], 0), width)
        todo += [((*way, (v, w)), min(width, n)) for u, v, w, n, _ in follow if (u, v) == way[-1] and (v, w) not in way]
    table_ = spark.createDataFrame([(*s, n) for s, n in welds.items()], "u string, v string, n long")
    home = spark.createDataFrame([(f"{g}p{i}", f"{g}") for g in range(3) for i in range(7)], "path string, component string")
    told = transcripts.ways_in(table_, spark.createDataFrame(follow, "u string, v string, w string, n long, phased boolean"), home)
    got = {(r.u, r.v): (r.width, r.route) for r in told.collect()}
    assert got.keys() == welds.keys() and begins and best
    for s, (width, route) in got.items():
        steps = list(zip(route, route[1:]))
        assert steps[-1] == s and len(set(steps)) == len(steps)
        assert width == min(welds[x] for x in steps)
        if s in best:
            assert width == best[s]
