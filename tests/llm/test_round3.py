"""Operators 11 to 13 against brute-force versions and the library."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import xxhash  # noqa: E402
from strandlake.llm import importance, merkle_manifest, rank_queue, rule_ensemble, word_bpe  # noqa: E402
from tests.llm.test_operators import WORD, documents, texts, words  # noqa: E402

MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["don't  we'LL x", "ÀÉ Σίσυφος İstanbul ﬁ ½² ٣٤", "a\x1cb\x85c　d \n\n\t x", "<|endoftext|>", "the" * 3000, "中文字 🙂🙂👩‍👩‍👧", "   ", "a" * 5000, "\x00\x7f", "=" * 999 + "ab" * 700]


# ---- 13


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_is_in_order():
    rnd, queue, held = random.Random(4), rank_queue.RankQueue(300_000), {}
    for _ in range(3000):
        if rnd.random() < 0.6:
            rank, at = rnd.choice([rnd.randrange(300_000), rnd.randrange(90)]), rnd.randrange(1000)
            queue.buckets[rank].append(at) if rank in queue.buckets else queue.open(rank, [at])
            held.setdefault(rank, []).append(at)
        elif held:
            least = min(held)
            assert queue.pop() == (least, sorted(held.pop(least)))
        assert bool(queue) == bool(held)


def test_byte_encoding_is_the_librarys(library):
    bpe = rank_queue.load(MULTI, PATTERN)
    cases = [t or "" for t in texts()] + ODD
    for _ in range(2):  # the second time from known pre-tokens
        e = bpe.encode_batch(cases)
        back = list(bpe.decoded_bytes(e, tokens=100))
        for i, t in enumerate(cases):
            want = library.encode_ordinary(t)
            assert e.of(i).tolist() == want and back[i] == t.encode() == library.decode_bytes(want) == bpe.decode(want)
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    rnd = random.Random(6)
    planes = [every, every[:0x2000], every[0x900:0xE00], [*"aAsS tT'σΣ ́\n\t .!1²3中🙂ll'"]]
    cases = [f"a{c}b {c}1{c}" for c in every[::31]] + ["".join(rnd.choice(planes[i % 4]) for _ in range(rnd.randint(1, 40))) for i in range(20_000)]
    e = bpe.encode_batch(cases)
    for i, want in enumerate(map(library.encode_ordinary, cases)):
        assert e.of(i).tolist() == want, cases[i]


def test_every_character_is_split_as_the_library_does(library):
    import tiktoken

    bpe = rank_queue.load(MULTI, PATTERN)
    every = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    singles = {bytes([b]): b for b in range(256)}
    for i in range(0, len(every), 40_000):
        some = every[i : i + 40_000]
        cases = [f"{c}{tail}" for c in some for tail in "a1"]
        probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=singles | {x.encode(): 256 + k for k, x in enumerate(cases)}, special_tokens={})
        told = [len(x) == 1 for x in map(probe.encode_ordinary, cases)]
        assert [len(bpe.numbers(x)) == 1 for x in cases] == told
    rank_queue.load.cache_clear()  # what has been numbered is not encoded yet


def test_pre_tokens_share_a_queue_without_touching(library, monkeypatch):
    bpe = rank_queue.ByteBpe(MULTI, PATTERN)
    rnd = random.Random(8)
    pieces = ["".join(rnd.choice("abetr") for _ in range(rnd.randint(1, 60))).encode() for _ in range(3000)] + [b"ab" * 4000]
    want = [library._encode_single_piece(p) for p in pieces]
    for together in (1, 64, 10**6):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        assert bpe.merge(pieces) == want
    monkeypatch.setattr(bpe, "MOST_KNOWN", 50)
    monkeypatch.setattr(bpe, "LONG", 10)
    for t in (words(1, 300), words(2, 300), words(1, 300)):
        assert bpe.encode_batch([t, None, t]).of(2).tolist() == library.encode_ordinary(t) and len(bpe.known) == 50


def test_byte_digests_and_round_trip(spark, library):
    rows = list(enumerate(texts() + ODD)) + [(0, texts()[0]), (None, "x"), (None, None)]
    docs = documents(spark, rows)
    got = rank_queue.digests(docs, MULTI, PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    back = rank_queue.decode(rank_queue.encode(docs.withColumn("ids", F.lit(1)), MULTI, PATTERN), MULTI, PATTERN).collect()
    assert sorted(str((r.doc_id, r["bytes"] and bytes(r["bytes"]).decode())) for r in back) == sorted(str((i, t if t is None else t or b"")) for i, t in rows)
    assert rank_queue.digests(documents(spark, []), MULTI, PATTERN).count() == 0


# ---- 12


def joined(x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def manifest_by_force(rows):
    """rows: source, doc_id, leaf, folded."""
    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    trees = {}
    for r in sorted(rows, key=lambda r: (order(r[0]), order(r[1]), r[2])):
        trees.setdefault(r[0], []).append(r)

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([joined(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climb(levels, i, h, proof):
        for level in levels[:-1]:
            a = i - i % 16
            proof += level[a:i] + level[i + 1 : a + 16]
            h, i = joined(level[a:i] + [h] + level[i + 1 : a + 16]), i // 16
        return h

    inner = [up([r[2] for r in held]) for held in trees.values()]
    outer = up([x[-1][0] for x in inner])
    out = []
    for k, (levels, held) in enumerate(zip(inner, trees.values(), strict=True)):
        for i, r in enumerate(held):
            proof = []
            h = climb(outer, k, climb(levels, i, r[3] or r[2], proof), proof)
            out.append((r[1], r[2], levels[-1][0], outer[-1][0], joined(proof), h, h == outer[-1][0]))
    return out


def same_rows(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_manifest_of_odd_sources(spark):
    rnd = random.Random(9)
    rows = []
    for s, n in ((None, 3), ("", 1), ("a", 16), ("b", 17), ("ä", 256), ("B", 257), ("z", 300), *((f"s{i}", 1 + i % 3) for i in range(40))):
        rows += [(s, rnd.choice([None, i, i, i // 2]), joined([str(s), str(i)]), joined(["x", str(i)]) if i % 5 == 0 else None) for i in range(n)]
    rows += rows[:30]  # repeated rows
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string, folded string").withColumn("tree", F.lit("clash")).withColumn("pos", F.lit(1))
    got = merkle_manifest.manifest(leaves).collect()
    # of leaves that are alike but for what is folded, the order is that of folded, null first
    same_rows(got, manifest_by_force(sorted(rows, key=lambda r: r[3] or "")))
    assert merkle_manifest.manifest(leaves.limit(0)).count() == 0
    one = merkle_manifest.manifest(leaves.where("source = ''").limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == joined([])


def test_manifest_over_many_superblocks(spark):
    n = 70_000
    rows = [("hot" if i % 3 else f"s{i % 300}", i, joined([str(i)]), joined(["!", str(i)]) if i % 1000 == 0 else None) for i in range(n)]
    rows += [("wide", n + i, joined(["w", str(i)]), None) for i in range(70_000)]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string, folded string")
    got = merkle_manifest.manifest(leaves).collect()
    same_rows(got, manifest_by_force(rows))
    assert sum(not r.verified for r in got) == 70


def test_manifest_query(spark, tmp_path):
    rows = [(i, t, "s" if i % 3 else None, None if i % 7 == 0 else "en", i) for i, t in enumerate(texts())] + [(None, "Null ID", "s", "en", None), (3, texts()[3], None, "en", 3)]
    spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, leaf string").write.parquet(str(tmp_path / "documents.parquet"))
    own = []
    for i, t, s, lang, n in rows:
        leaf = lambda text: joined(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, text)])  # noqa: B023, E731
        lower = None if t is None else t.translate({c: c + 32 for c in range(65, 91)})
        own.append((s, i, leaf(t), leaf(lower) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None))
    same_rows(merkle_manifest.op12_manifest(spark, str(tmp_path)).collect(), manifest_by_force(own))


# ---- 11


def own_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def runs(t, n_max):
    w = own_words(t)
    return [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def resampled_by_force(rows, target, n_max, buckets, least, percent, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for into, source in ((s, [t for _, t in rows]), (t, target)):
        for x in source:
            for f in runs(x, n_max):
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    held = []
    for i, x in rows:
        weight = sum(gain[bucket(f)] for f in runs(x, n_max))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        held.append([i, len(runs(x, n_max)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own_words(x)) >= least])
    able = sorted((r for r in held if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in held]


@pytest.mark.parametrize(("n_max", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_resampling(spark, n_max, buckets, percent):
    rows = list(enumerate(texts())) + [(0, texts()[0]), (0, texts()[1]), (None, texts()[2]), (None, None), (77, "é" * 40 + " " + "x" * 33 + " " + "é" * 40)] + [(100 + i, words(300 + i, 25)) for i in range(30)]
    target = [words(5, 60), words(301, 40), None, ""]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    docs = documents(spark, rows).withColumn("bucket", F.lit(3)).withColumn("score", F.lit("clash"))
    got = importance.resample(docs, wanted, n_max, buckets, 20, percent).collect()
    same_rows(got, resampled_by_force(rows, target, n_max, buckets, 20, percent, 2024))
    if n_max == 1:
        assert importance.resample(docs.limit(0), wanted).count() == 0
        none = importance.resample(docs, wanted.limit(0), 1, buckets).collect()
        same_rows(none, resampled_by_force(rows, [], 1, buckets, 20, 10, 2024))


def test_interned_strings_are_told_apart_by_bytes(monkeypatch):
    rnd = random.Random(12)
    held = [rnd.choice(["", "é", "ab"]) + "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 5, 9, 20, 31, 32, 40]))) for _ in range(6000)] * 2
    column = pa.array([" ".join(held), None, "", "z"])
    for same in (False, True):
        if same:  # all keys of a length alike: only bytes tell the strings apart
            monkeypatch.setattr(importance, "xxh64_short", lambda lanes, lengths: lengths.astype(np.uint64) % 3)
            monkeypatch.setattr(importance.xxhash, "xxh64_intdigest", lambda b: 5)
            held = held[:600]
            column = pa.array([" ".join(held), None, "", "z"])
        interned, per_text, _ = importance.features(column, 1, 50)
        assert per_text.tolist() == [len(held), 0, 0, 1]
        seen = {}
        for w, slot in zip([*held, "z"], interned.slots.tolist(), strict=True):
            assert seen.setdefault(w, slot) == slot and interned.bucket[slot] == zlib.crc32(w.encode()) % 50
        assert len(set(seen.values())) == len(seen) and {w: int(interned.count[s]) for w, s in seen.items()} == {w: [*held, "z"].count(w) for w in seen}


def test_vectorised_hash_is_xxh64():
    rnd = np.random.default_rng(3)
    held = [rnd.integers(0, 256, n, dtype=np.uint8).tobytes() for n in range(32) for _ in range(20)]
    lanes = np.stack([np.frombuffer(x.ljust(32, b"\0"), "<u8") for x in held])
    got = importance.xxh64_short(lanes, np.array([len(x) for x in held]))
    assert got.tolist() == [xxhash.xxh64_intdigest(x) for x in held]


# ---- 4 and 5


def test_chunks_of_equal_hashes_are_encoded_each(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    pairs = [("qogbokmrsk", "lkkfevrarw"), ("ufyydzegym", "xztvvcmzxq"), ("vlphlwgnuf", "kobdwdywhd")]
    for a, b in pairs:
        hashes = word_bpe.split_chunks(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, 21]))[2]
        assert hashes[0] == hashes[1]
    together = [" ".join(x for p in pairs for x in (*p, *p)), "plain words"]
    apart = [[a for a, _ in pairs], [b for _, b in pairs], [b for _, b in pairs], [a for a, _ in pairs], together]
    many = [[t or "" for t in texts()], [words(3, 200), "x" * 70 + "a " + "x" * 70 + "b", "x" * 49 + "a " + "x" * 49 + "b"]]
    for same in (False, True):
        if same:  # hashes of two kinds only
            split = word_bpe.split_chunks
            monkeypatch.setattr(word_bpe, "split_chunks", lambda data, bounds: (lambda s, n, h, p: (s, n, h % np.uint64(2), p))(*split(data, bounds)))
        for batches in ([together], apart, apart[::-1], many + many):
            bpe = word_bpe.WordBpe(WORD)
            for cases in batches:
                e = bpe.encode_batch(cases)
                assert [e.of(i).tolist() for i in range(len(cases))] == [library.encode(t, add_special_tokens=False).ids for t in cases]


def test_quality_of_few_and_of_equal_labelled_texts(spark):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(7)] + [(None, None, 1)], "doc_id long, text string, `a.b` int")
    model = rule_ensemble.fit(docs, labels([(i, i % 2) for i in range(7)]))
    assert not model.weights and len({r.score for r in rule_ensemble.classify(docs, model).collect()}) == 1
    assert rule_ensemble.keep_good(docs, model).columns == docs.columns and rule_ensemble.keep_good(docs, model).count() in (0, 8)
    equal = spark.createDataFrame([(i, "the same text") for i in range(60)], "doc_id long, text string")
    assert not rule_ensemble.fit(equal, labels([(i, i % 2) for i in range(60)])).weights
    many = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text")).unionByName(equal)
    seen, kind = [], type(many)
    held = kind.toPandas
    try:
        kind.toPandas = lambda self: (seen.append(len(out := held(self))), out)[1]
        rule_ensemble.fit(many, labels([(i, i % 2) for i in range(60)]), max_rows=40)
    finally:
        kind.toPandas = held
    assert seen and seen[0] <= 40


# ---- 7 and the pipeline


def test_a_batch_of_texts_takes_little_memory(spark):
    import tracemalloc

    import pyarrow as pa

    from strandlake.llm import curve_packing, ngram_join

    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for plan in (curve_packing.pack, lambda d, _: ngram_join.near_duplicates(d)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        plan(docs, WORD)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    column = pa.array([words(i, 500) for i in range(2000)], pa.string())  # some 5 MB
    data = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8)
    tracemalloc.start()
    try:
        word_bpe.split_chunks(data, np.array([0, len(data)]))
        assert tracemalloc.get_traced_memory()[1] < 16 * len(data)
    finally:
        tracemalloc.stop()


def test_hashes_of_chunks_are_sums_of_the_table():
    cases = [b"a", b"abc", b"\x00x\x00", "ÀÉß".encode(), b"y" * 48, bytes(range(0x21, 0x60))[:47]] * 3
    data = np.frombuffer(b" ".join(cases), np.uint8)
    starts, lengths, hashes, per_text = word_bpe.split_chunks(data, np.array([0, len(data)]), step=4)
    assert [data[s : s + n].tobytes() for s, n in zip(starts, lengths)] == cases and per_text.tolist() == [len(cases)]
    assert hashes.tolist() == [sum(int(word_bpe.TABLE[k * 256 + b]) for k, b in enumerate(c)) % 2**64 for c in cases]


def test_plain_words_are_encoded_without_a_call_each(monkeypatch):
    from tokenizers import Tokenizer

    library, bpe, seen = Tokenizer.from_file(WORD), word_bpe.WordBpe(WORD), []
    split = word_bpe.WordBpe._split
    monkeypatch.setattr(word_bpe.WordBpe, "_split", lambda self, chunk: (seen.append(chunk), split(self, chunk))[1])

    def same(cases):
        e = bpe.encode_batch(cases)
        assert [e.of(i).tolist() for i in range(len(cases))] == [library.encode(t, add_special_tokens=False).ids for t in cases]

    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if chr(c) not in "×÷"]
    same([" ".join(f"{c}{mark} b{c}{mark} {c}{d}" for c in letters for d in "zÉß" for mark in ("", ".", ","))] + ["x" * n for n in range(1, 80)])
    assert not seen
    rnd = random.Random(11)
    signs = [*"abcQXYZÀÉßÿñ×÷.,.,'!2", "é", "Σ", "ı", "İ", "中", "́", "Ã", "¾", "<|endoftext|>", "\x00", "　"]
    same(["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 70))) for _ in range(4000)] + [".", ",", "..", "a..", "a.,", ".a", "É", "É.", "×.", "é."])
    assert seen
