import random
import zlib

import numpy as np
import pytest

from tallymill.llm import idfiles
from tallymill.llm.common import open_fs


def test_encoder_as_the_library():
    encoder, rng = idfiles.Encoder(idfiles.default_vocabulary(), most=500), random.Random(1)
    alphabet = "ab'stre  \n\té中½!—\xa0\x1c\x85.,Z9"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "a<|endoftext|>b", "x " * 500, "é" * 300]
    got = [x for i in range(0, len(texts), 300) for x in encoder.encode(texts[i : i + 300])]
    want = [np.array(e.ids, dtype=encoder.width).tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def whole(docs):
    encoder = idfiles.Encoder(idfiles.default_vocabulary())
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    out, start = [], 0
    for r in rows:
        ids = [*encoder.library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_as_brute_force(real):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in idfiles.read_ids(idfiles.write_ids(real)).collect())
    assert got == whole(real)


def test_odd_rows(docs, none):
    rows = idfiles.read_ids(idfiles.write_ids(docs)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [r[0] for r in whole(docs)]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert sorted(zlib.crc32(r["ids"]) for r in rows) == sorted(r[3] for r in whole(docs))
    assert idfiles.read_ids(idfiles.write_ids(none)).count() == 0


def test_single_documents_and_wrong_dictionary(real):
    row = idfiles.write_ids(real).orderBy("part").first()
    fs, at = open_fs(row["folder"])
    with fs.open_input_stream(f"{at}/dictionary") as f:
        dictionary = f.read()
    file = idfiles.IdFile(fs, row["path"], dictionary)
    rows = list(file)
    assert len(rows) == row["docs"] and file.document(2)[0] == rows[2][0] and (file.document(2)[1] == rows[2][1]).all()
    with pytest.raises(ValueError):
        idfiles.IdFile(fs, row["path"], b"other")


def test_equal_rows_fill_several_files(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 3000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = idfiles.write_ids(rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(manifest) > 2 and sum(r["docs"] for r in manifest) == 3000


def test_ids_have_to_be_integers(spark):
    with pytest.raises(ValueError):
        idfiles.write_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_long_text(spark):
    rows = spark.createDataFrame([(1, "lorem ipsum, dolor " * 120_000), (2, "x" * 50_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in idfiles.read_ids(idfiles.write_ids(rows)).collect())
    assert got == whole(rows)
