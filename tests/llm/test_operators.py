"""The operators against brute-force versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandlake.llm import ball_tree, bpe_codec, curve_packing, merge_index, merkle_audit, ngram_join, ngram_trie, quote_links, rule_ensemble, token_counts, word_bpe  # noqa: E402
from strandlake.operators.components import connected_components  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, digest string, node string, rid string"


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice("the of thing ouer And, ünd été 12 x't don't").lower() if rnd.random() < 0.05 else "".join(rnd.choice("aeiouthnrs") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rnd, parts = random.Random(seed), text.split()
    for _ in range(int(len(parts) * share)):
        parts[rnd.randrange(len(parts))] = "".join(rnd.choice("aeioxyz") for _ in range(5))
    return " ".join(parts)


def texts() -> list:
    base = [words(i, 120) for i in range(6)]
    out = base + [edited(b, 7 * i + k, 0.02 * k) for i, b in enumerate(base) for k in range(5)]
    out += [base[0], base[0].replace(" ", "\n\t"), base[1].upper(), "", None, "one", "One", "a b c", "a b c d e", "A b c d e f", " \n ", words(99, 5000), "x" * 3000]
    out += [words(50 + i, 12) for i in range(4)] + [words(50, 12)]
    return out


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "d", "n", "r") for i, t in rows], DOCS)


def tokens(text) -> list:
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


# ---- 5 and 7


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


ODD = ["don't  stop!!", "ÀÉ Σίσυφος İstanbul ﬁ ½²", "a\x1cb\x85c　d", "<|endoftext|>x<|startoftext|> <|end", "the" * 2000, "中文字 🙂🙂", "é x", "x" * 50 + "y" * 60]


def test_encoding_is_the_librarys(library):
    bpe = word_bpe.load(WORD)
    cases = [t or "" for t in texts()] + ODD
    for _ in range(2):  # the second time from known chunks
        e = bpe.encode_batch(cases)
        shown = list(bpe.decoded_bytes(e, tokens=100))
        for i, t in enumerate(cases):
            want = library.encode(t, add_special_tokens=False).ids
            assert e.of(i).tolist() == want
            assert shown[i].decode() == library.decode(want, skip_special_tokens=False) == bpe.decode(want)


def test_encoding_of_every_character(library):
    bpe = word_bpe.load(WORD)
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    for cases in ([f"a{c}b" for c in every], [f"{c}É{c}\u0301 {c}" for c in every[: 2**16]]):
        e = bpe.encode_batch(cases)
        for i in range(0, len(cases), 50_000):
            want = library.encode_batch(cases[i : i + 50_000], add_special_tokens=False)
            assert all(e.of(i + k).tolist() == w.ids for k, w in enumerate(want))
    rnd = random.Random(5)
    planes = [every, [chr(x) for x in range(0x2000)], [chr(x) for x in range(0x900, 0xE00)], [*"aAsStTmM'σΣ \u0301\u0307İıßﬁ.,!1²³中🙂", "<|endoftext|>"]]
    cases = ["".join(rnd.choice(planes[i % 4]) for _ in range(12)) for i in range(10_000)]
    e = bpe.encode_batch(cases)
    assert all(e.of(k).tolist() == w.ids for k, w in enumerate(library.encode_batch(cases, add_special_tokens=False)))


def test_bpe_digests_and_round_trip(spark, library):
    docs = documents(spark, list(enumerate(texts() + ODD)) + [(0, texts()[0]), (None, "x")])
    rows = bpe_codec.digests(docs, WORD).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.ids_sha256) for r in rows}
    for i, t in enumerate(texts() + ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) in by
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(docs, WORD), WORD).collect()}
    assert back[5] == library.decode(library.encode(texts()[5], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe_codec.digests(documents(spark, []), WORD).count() == 0


def test_packing(spark, library):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (3, texts()[3]), (None, None)]
    pieces = curve_packing.pack(documents(spark, rows), WORD, 512).toPandas()
    assert sorted(pieces.groupby("sequence_id").length.sum().tolist(), reverse=True)[:-1] == [512] * (pieces.sequence_id.nunique() - 1)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
    want = collections.Counter()
    for i, t in rows:
        want[-1 if i is None else i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert pieces.assign(doc_id=pieces.doc_id.fillna(-1)).groupby("doc_id").length.sum().to_dict() == dict(want)
    coded = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    for p in pieces.itertuples():  # doc_id 3 is there three times with one text
        ids = coded[None if math.isnan(p.doc_id) else int(p.doc_id)]
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
    assert curve_packing.pack(documents(spark, []), WORD).count() == 0


def test_hilbert_keys_walk_the_grid():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve_packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ---- 8


def test_deduplication(spark):
    rows = list(enumerate(texts())) + [(0, texts()[0]), (None, texts()[2]), (None, "only null")]
    got = merge_index.deduplicate(documents(spark, rows), memtable_rows=5, fan_in=2).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    clashing = documents(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(("row", "id", "d", "keeper", "kept", "run", "__id", "gone", "w"))})
    held = merge_index.keep_first(clashing)
    assert held.columns == clashing.columns and held.count() == len(groups)
    twice = spark.createDataFrame([(5, "a b", "y"), (5, "a  b", "x"), (5, "other", "z"), (6, "a b", "w")], "doc_id long, text string, more string")
    assert sorted((r.doc_id, r.text, r.more) for r in merge_index.keep_first(twice).collect()) == [(5, "a  b", "x"), (5, "other", "z")]
    assert merge_index.keep_first(documents(spark, [])).count() == 0
    assert merge_index.deduplicate(documents(spark, [])).count() == 0


def test_colliding_digests_are_told_apart(spark):
    held = documents(spark, [(1, "a"), (2, "b"), (3, "a")]).selectExpr("doc_id", "text as norm", "cast('same' as binary) as digest")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in merge_index.by_text(held).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}


# ---- 6


def components_by_force(rows) -> dict:
    sets, root = {}, {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rounds", [0, 3])
def test_jaccard_join(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    rows = list(enumerate(texts()))
    rows += [(1000 + k, edited(words(7, 40), k, 0.03)) for k in range(12)] + [(2000 + k, edited(words(8, 300), k, 0.02)) for k in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == components_by_force(rows)


def test_jaccard_join_at_its_edges(spark):
    rows = [(1, words(1, 30)), (1, words(1, 30)), (2, words(1, 30)), (3, None), (4, None), (None, words(1, 30)), (None, words(1, 30) + " more"), (5, words(1, 30) + " more and more")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, 1), (-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 1)]
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a b c", "one", "one two", "a b c d", "a b c d e"])
def test_jaccard_join_of_one_short_text(spark, text):
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, [(1, text)])).collect()] == [(1, 1, 1)]


def test_jaccard_join_below_the_default_share(spark):
    long = [words(300 + i, 34) for i in range(6)]
    rows = [(2 * i, t) for i, t in enumerate(long)] + [(2 * i + 1, " ".join(t.split()[:19])) for i, t in enumerate(long)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [tokens(t)]]
    assert all(2 * len(a & b) >= len(a | b) for a, b in zip(sets[:6], sets[6:]))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(documents(spark, rows), 50).collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}


def test_connected_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(5, 5), (300, 301), (301, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# ---- 3


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rnd.normal(size=(400, 8)).round(2).tolist())]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [0.5]), (None, [1.0]), (7, rows[7][1]), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ball_tree.integer_vectors(df)
    got = ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=64, block_rows=3).collect()
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 50 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in ranked]
    mixed = spark.createDataFrame([(i, v) for i, v in enumerate(rnd.normal(size=(60, 3)).tolist())] + [(60, [2.0**24, 0.0, 1.0]), (100, [-(2.0**25), 3.0, 0.5]), (101, [2.0**24, 0.0])], "vec_id long, embedding array<double>")
    v = ball_tree.integer_vectors(mixed)
    whole = {r.vec_id: r.v for r in v.collect()}
    got = ball_tree.top_k(v, v.where("vec_id % 50 = 0"), 3, shard_rows=16).collect()
    for q in (0, 50, 100):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:3]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == ranked
    two = ball_tree.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [3.0])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, two.collect())) == [(0, [256]), (1, [768])]
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [3e9, 2.0]), (2, [-4e9, 0.0])], "vec_id long, embedding array<double>")
    v = ball_tree.integer_vectors(big)
    assert [(r.vec_id, r.rank) for r in ball_tree.top_k(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = ball_tree.integer_vectors(df.where("false"))
    assert ball_tree.top_k(none, none).count() == 0


# ---- 10


def model_by_force(rows):
    c, pairs, total, kids = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    lists = [(i, [*tokens(t), None]) for i, t in rows]
    for i, w in lists:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
            pairs.update(zip([None, *w], w))
    for (a, _), n in pairs.items():
        total[a] += n
        kids[a] += 1
    n1, n2 = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d = min(0.95, max(0.1, n1 / (n1 + 2 * n2)))
    size, v = sum(c.values()), len(c)
    for i, w in lists:
        uni = [(c[x] + 0.5) / (size + 0.5 * (v + 1)) for x in w]
        bi = [max(pairs.get((a, b), 0) - d, 0) / total[a] + d * kids[a] / total[a] * u if a in total else u for a, b, u in zip([None, *w], w, uni)]
        yield i, len(w), sum(c[x] > 0 for x in w), size, sum(map(math.log10, uni)), sum(map(math.log10, bi))


def test_language_model(spark):
    rows = list(enumerate(texts())) + [(0, texts()[0])]
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.train_and_score(documents(spark, rows)).collect())
    for a, b in zip(got, sorted(model_by_force(rows)), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], abs=3e-4 * a[1] + 1e-9)
    assert ngram_trie.train_and_score(documents(spark, [])).count() == 0
    only = ngram_trie.train_and_score(documents(spark, [(i, "a b") for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 1])).first()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)


def test_language_model_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_PAIRS", 40)
    rows = list(enumerate(texts()[:12])) + [(100 + i, " ".join(f"hot {w}" for w in words(i, 40).split())) for i in range(6)]
    got = sorted((r.doc_id, r.score) for r in ngram_trie.train_and_score(documents(spark, rows)).collect())
    for (i, s), want in zip(got, sorted(model_by_force(rows)), strict=True):
        assert i == want[0] and s == pytest.approx(want[5], abs=3e-4 * want[1] + 1e-9)


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (50, 60), (1000, 2**40), (300, 2**63)])
def test_elias_fano(n, universe):
    rnd = np.random.default_rng(n)
    values = np.sort(rnd.integers(0, universe, size=n, dtype=np.uint64))
    ef = ngram_trie.EliasFano(ngram_trie.elias_fano(values, universe))
    if n:
        assert (ef.at(np.arange(n)) == values).all()
        asked = np.concatenate([values, rnd.integers(0, int(values[-1]) + 1, size=200, dtype=np.uint64)])
        at, found = ef.successor(asked)
        assert (found == np.isin(asked, values)).all()
        assert (at[found] == np.searchsorted(values, asked[found])).all()


# ---- 4


def test_rule_ensemble(spark):
    good, bad = [words(i, 80) for i in range(60)], [" ".join(["spam!!"] * 40 + [words(i, 5)]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (0, good[0])]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, 1), (None, 0), (700, 1), (501, None)], "doc_id long, quality int")
    docs = documents(spark, rows)
    model = rule_ensemble.fit(docs, labels)
    got = rule_ensemble.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 120]
    assert held and all((r.score >= 0.5) == (r.doc_id < 60) for r in held)
    assert 0 < len(model.weights) < 200
    kept = {r.doc_id for r in rule_ensemble.keep_good(docs, model).collect()}
    assert set(range(60)) <= kept and not kept & set(range(60, 120))
    alone = rule_ensemble.fit(docs, labels.where("false"))
    assert alone.weights == () and rule_ensemble.classify(docs, alone).first().score == pytest.approx(0.5)


def test_statistics_and_compiled_rules_by_force(spark):
    cases = [t or "" for t in texts()] + ["a a a b\nA B, C. 12!|", "\n\n", "ß é ½ x" * 9, "y" * 40_000 + " z"]
    held = rule_ensemble.with_statistics(documents(spark, list(enumerate(cases))), "doc_id").orderBy("doc_id")
    x = np.array([[r[f"q_{n}"] for n in rule_ensemble.NAMES] for r in held.collect()])

    def force(t: str) -> list:
        w, lines, n = [p for p in re.split("[\x20\x09-\x0d]+", t) if p], t.split("\n"), max(1, len(t))
        share = lambda keep: sum(map(keep, t)) / n
        return [
            len(t), len(w), len(t) / max(1, len(w)), max(map(len, w), default=0), len(set(w)) / max(1, len(w)), sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)), sum(len(p) <= 2 for p in w) / max(1, len(w)),
            len(lines), len(set(lines)) / len(lines), len(t) / len(lines), share(lambda c: "A" <= c <= "Z"), share(lambda c: not (c.isalpha() or c.isnumeric() or c in " \t\n\r\x0b\x0c.,")), share(lambda c: c in "0123456789"),
            *(share(lambda c, m=m: c == m) for m in ".,|!"),
        ]

    assert x == pytest.approx(np.array([force(t) for t in cases]), abs=1e-12)
    y = (np.arange(len(x)) % 3 > 0).astype(float)
    rules = rule_ensemble.grow(np.repeat(x, 5, axis=0), np.repeat(y, 5), trees=6)
    weights = np.linspace(-1, 1, len(rules))
    model = rule_ensemble.RuleModel(0.25, tuple(zip(rules, weights.tolist(), strict=True)))
    want = 1 / (1 + np.exp(-(0.25 + np.stack([r.holds(x) for r in rules], axis=1) @ weights)))
    assert len(rules) > 10 and [r.s for r in held.select(model.score().alias("s")).collect()] == pytest.approx(want.tolist())
    empty = documents(spark, [])
    assert rule_ensemble.classify(empty, model).count() == 0 and rule_ensemble.fit(empty, spark.createDataFrame([], "doc_id long, quality int")).weights == ()


# ---- 9


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    cases = ["ab cd\n\n\nef gh\n", "", None, "été 🙂🙂\n 中文\n\n", "x  \n   \n y", words(3, 50).replace(" th", "\n th"), "\n"]
    got = token_counts.section_counts(documents(spark, list(enumerate(cases))), BYTE, rule).collect()
    encoding, sizes = token_counts.encoder(BYTE)
    for i, t in enumerate(cases):
        t = t or ""
        rows = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == i)
        assert "".join(t[a:z] for _, a, z, _ in rows) == t
        want = collections.Counter()
        ids, at = encoding.encode_ordinary(t), 0
        owner = [s for s, a, z, _ in rows for _ in range(a, z)]
        place = [k for k, c in enumerate(t) for _ in c.encode()]
        for x in ids:
            chars = sorted(set(place[at : at + int(sizes[x])]))
            at += int(sizes[x])
            own = collections.Counter(owner[c] for c in chars)
            if rule == "split":
                for s, n in own.items():
                    want[s] += n / len(chars)
            else:
                want[{"first": owner[chars[0]], "last": owner[chars[-1]], "majority": min(own, key=lambda s: (-own[s], s))}[rule]] += 1
        assert [n for *_, n in rows] == pytest.approx([want[s] for s, *_ in rows])
        assert sum(n for *_, n in rows) == pytest.approx(len(ids))


def test_token_counts_of_given_sections(spark):
    docs = spark.createDataFrame([(1, "hello world", [5, 40]), (2, "hello", None), (3, None, [3])], "doc_id long, text string, ends array<int>")
    got = sorted((r.doc_id, r.start, r.end, r.n_tokens) for r in token_counts.section_counts(docs, BYTE, ends="ends").collect())
    assert got == [(1, 0, 5, 1), (1, 5, 11, 1), (2, 0, 5, 1), (3, 0, 0, 0)]


# ---- 1


def test_merkle_audit(spark):
    rows = [("v", i, f"record {i}") for i in range(0, 3000, 3)] + [("w", 5, "a"), ("w", 5, "b"), ("w", 5, "a"), (None, None, None)]
    schema = "volume string, offset long, record string, node string"
    a = spark.createDataFrame([(*r, "x") for r in rows], schema)
    changed = [r for r in rows if r[:2] != ("v", 300)]
    changed[7] = (*changed[7][:2], "rotten")
    changed += [("v", 100_000, "stray"), ("w", 5, "b")]
    b = spark.createDataFrame([(*r, "y") for r in changed], schema)
    got = sorted((r.volume, r.offset, r.status) for r in merkle_audit.audit(a, b, span=8, fanout=4).collect())
    assert got == [("v", 21, "altered"), ("v", 300, "missing"), ("v", 100_000, "extra"), ("w", 5, "altered")]
    assert merkle_audit.audit(a, a).count() == 0
    assert merkle_audit.audit(a.where("false"), a.where("false")).count() == 0


# ---- 2


def test_quotation_links(spark):
    rows = [
        (1, 0, "a", "First words.\n\nSecond  Paragraph here"), (1, 1, "b", "> first   words.\nI agree"), (1, 2, "a", ">> First words.\n> I agree\n\nSo do I"),
        (1, 3, "c", "> second paragraph HERE\nno"), (1, 4, "c", "> never said\nmy own"), (1, 4, "c", "> never said\nmy own"), (2, 0, "a", None), (2, 1, "b", ""),
        (None, 0, "a", "> First words.\nx"), (3, None, "a", "y"), (3, 1, "a", "> y\n>\n> > deep\nz"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quote_links.in_reply_order(quote_links.link(df)).collect()
    assert len(got) == len(rows)
    one = {(r.turn, r.body): (r.reply_to, r.thread, r.reply_depth, r.n_quotes, r.n_linked) for r in got if r.conv_id == 1}
    assert one == {
        (0, "First words.\n\nSecond  Paragraph here"): (None, 0, 0, 0, 0), (1, "I agree"): (0, 0, 1, 1, 1), (2, "So do I"): (1, 0, 2, 2, 2), (3, "no"): (0, 0, 1, 1, 1), (4, "my own"): (None, 4, 0, 1, 0),
    }
    order = [(r.turn, r.position) for r in sorted(got, key=lambda r: r.position) if r.conv_id == 1]
    assert order == [(0, 0), (1, 1), (3, 2), (2, 3), (4, 4), (4, 5)]
    assert quote_links.in_reply_order(quote_links.link(df.where("false"))).count() == 0


def linked_by_force(rows) -> dict:
    """(conv_id, turn) -> (reply_to, thread, depth, n_quotes, n_linked, body) of unique turns, line by line."""
    said, parsed = {}, {}
    for c, t, _, text in rows:
        runs = []
        for line in re.split("\r?\n", text or ""):
            marks = re.match(r"(?:[ \t]*>)+", line)
            depth, rest = (marks[0].count(">"), re.sub("^ ", "", line[marks.end() :])) if marks else (0, line)
            blank = not rest.strip(" ")
            if not runs or runs[-1][0] != depth or blank or runs[-1][2]:
                runs.append([depth, [], blank])
            runs[-1][1].append(rest)
        parts = [(d, re.sub(r"\s+", " ", "\n".join(x).lower()).strip(" ")) for d, x, _ in runs if "\n".join(x).strip(" ")]
        body = "\n".join(x for x in re.split("\r?\n", text or "") if not re.match(r"(?:[ \t]*>)+", x))
        parsed[c, t] = parts, re.sub(r"^\s+|\s+$", "", body)
        for d, p in parts:
            if d == 0:
                said.setdefault((c, p), []).append(t)
    out = {}
    for c, t in sorted(parsed):
        parts, body = parsed[c, t]
        found = [(-d, min(said[c, p])) for d, p in parts if d and (c, p) in said and min(said[c, p]) < t]
        reply = max(found)[1] if found else None
        _, thread, depth, *_ = out.get((c, reply), (None, t, -1))
        out[c, t] = reply, thread if found else t, depth + 1 if found else 0, sum(d > 0 for d, _ in parts), len(found), body
    return out


def test_quotation_links_by_force(spark):
    rnd, rows = random.Random(8), []
    for c in range(12):
        before = []
        for t in range(rnd.randint(1, 9)):
            lines = [words(1000 * c + 10 * t + i, rnd.randint(1, 4)) for i in range(rnd.randint(1, 3))]
            quoted = []
            for m in rnd.sample(before, min(len(before), rnd.randint(0, 2))):
                quoted += [f"> {x}" if rnd.random() < 0.8 else f">{x.upper()}  " for x in m]
            text = quoted + ([""] if rnd.random() < 0.5 else []) + lines
            rows.append((c, t, "r", "\n".join(text) if rnd.random() < 0.95 else None))
            before.append(text)
    rows.append((99, 0, "r", "\n".join(words(i, 3) for i in range(3000))))
    rows.append((99, 1, "r", "\n".join("> " + words(i, 3) for i in range(3000)) + "\nend"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.reply_depth, r.n_quotes, r.n_linked, r.body) for r in quote_links.link(df).collect()}
    assert got == linked_by_force(rows)


def test_quoted_mail_is_unquoted_again(spark):
    rows = [(c, t, "r", f"line {c} {t}\nmore of {t} in {c}") for c in range(3) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quote_links.link(quote_links.quoted_mail(df)).collect()
    assert sorted((r.conv_id, r.turn, r.body) for r in got) == sorted((c, t, x) for c, t, _, x in rows)
    assert all(r.reply_to == (r.turn - 1 if r.turn else None) and r.reply_depth == r.turn for r in got)
