"""The stages after one another on a small corpus with junk, exact and near copies."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import WORD, edited, words  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402


def test_pipeline(spark, tmp_path):
    good = [words(100 + i, 90) for i in range(40)]
    rows = list(enumerate(good)) + [(100 + i, " ".join(["spam!!"] * 60 + [words(i, 6)])) for i in range(40)]
    rows += [(200, good[3].replace(" ", "  ")), (201, good[4]), (202, edited(good[5], 1, 0.02)), (203, edited(good[5], 2, 0.02))]
    long = " ".join(good[6:30])
    rows += [(300, long), (300, long), (301, None), (302, ""), (None, good[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more", 1, "g") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, row int, gone string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = docs, {}
    for name, step in corpus_pipeline.STAGES[:3]:
        at = step(spark, at, str(tmp_path))
        kept[name] = {r.doc_id for r in at.collect()}
        assert at.columns == docs.columns
    odd = kept["quality"] & {301, 302}  # texts without words may be rejected, but alike
    assert odd in (set(), {301, 302})
    assert kept["quality"] - odd == {i for i, _ in rows if i is None or not 100 <= i < 200} - {301, 302}
    odd -= {302}  # an empty text equals a null one
    assert kept["exact copies"] == kept["quality"] - {200, 201, 302, None} | odd
    assert kept["near copies"] == {*range(40), 300} | odd
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == {*range(40), 300} | odd
    library = Tokenizer.from_file(WORD)
    own = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    for doc_id, some in pieces.groupby("doc_id"):
        some = some.sort_values("start")
        assert some.start.tolist() == [0, *np.cumsum(some.length)[:-1].tolist()] and some.length.sum() == len(own[doc_id]) == some.doc_tokens.iloc[0]
        assert all(zlib.crc32(own[doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in some.itertuples())
    for _, some in pieces.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert some.offset.tolist() == [0, *np.cumsum(some.length)[:-1].tolist()] and some.length.sum() <= 4096
    none = tmp_path / "none"
    docs.limit(0).write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
