"""FASTQ by byte ranges gives the rows of the reader in order: plain, wrapped, compressed, misleading and broken files."""

import gzip
import random

import pytest

from strandlake.sources import ranges
from strandlake.sources import reads as R


def fastq(seed, n, wrap=None, ends="\n"):
    """Qualities begin with @ and + often."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        size = rnd.choice([0, 1, 7, 40, 90])
        seq, qual = "".join(rnd.choice("ACGTN") for _ in range(size)), "".join(rnd.choice("@+I!A") for _ in range(size))
        step = wrap or max(size, 1)
        cut = lambda s: [s[j : j + step] for j in range(0, len(s), step)] or [""]
        out += [f"@r{i} x", *cut(seq), rnd.choice(["+", f"+r{i} x"]), *cut(qual)]
        if rnd.random() < 0.1:
            out += [""] * rnd.randint(1, 3)
    return ends.join(out) + ends * rnd.randint(0, 2)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    there = tmp_path_factory.mktemp("fastq")
    (there / "a.fq").write_bytes(fastq(1, 200).encode())
    (there / "b.fq").write_bytes(fastq(2, 120, ends="\r\n").encode())
    (there / "c.fq").write_bytes(fastq(3, 150, wrap=6).encode())
    (there / "d e.fq.gz").write_bytes(gzip.compress(fastq(4, 100).encode()))
    (there / "e.fq").write_bytes(b"\n\n" + fastq(5, 3).encode())
    (there / "f.fq").write_bytes(b"")
    return there


def by_force(text):
    return [tuple(r) for r in R.parse_fastq(text.split("\n"))]


@pytest.mark.parametrize("split", [64, 1000])
def test_ranges_hold_every_record_once(spark, folder, split):
    made = ranges.read_fastq_ranges(spark, str(folder), split=split)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    got = {}
    for r in made.orderBy("read_id").collect():
        got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " "), []).append((r.read_id & ((1 << 33) - 1), r.label, r.seq, r.qlabel, r.qual))
    for name in ("a.fq", "b.fq", "c.fq", "e.fq", "d e.fq.gz"):
        raw = (folder / name).read_bytes()
        want = by_force((gzip.decompress(raw) if name.endswith("gz") else raw).decode().replace("\r\n", "\n"))
        assert got.pop(name) == [(i, *w) for i, w in enumerate(want)], name
    assert not got


def test_unchecked_ranges_and_nothing(spark, folder):
    made = ranges.read_fastq_ranges(spark, str(folder / "a.fq"), split=100, check=False)
    want = by_force((folder / "a.fq").read_text())
    assert [tuple(r) for r in made.orderBy("read_id").select("label", "seq", "qlabel", "qual").collect()] == want
    assert made.select("read_id").distinct().count() == len(want)
    assert ranges.read_fastq_ranges(spark, str(folder / "f.fq")).count() == 0


def test_the_reader_in_order_agrees(spark, folder):
    held = [R.read_fastq(spark, str(folder / "a.fq"), str(folder / "e.fq")), ranges.read_fastq_ranges(spark, str(folder / "a.fq"), str(folder / "e.fq"), split=300)]
    a, b = ([tuple(r) for r in h.select("file", "label", "seq", "qlabel", "qual").orderBy("file", "label").collect()] for h in held)
    assert a == b


def test_broken_records_stop(spark, tmp_path):
    (tmp_path / "bad.fq").write_text(fastq(6, 40) + "@x\nACGT\n+\n!!\n")
    with pytest.raises(Exception, match="bases"):
        ranges.read_fastq_ranges(spark, str(tmp_path / "bad.fq"), split=200).count()
