import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import bpe

public_tokenizers = __import__("public_tokenizers")


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})


LIBRARY = library()
alphabet = st.sampled_from(list("ab'streemvldé中१½ \n\t  ''—!9\u200b\x00\x1c\x85𝒳"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet, max_size=30), st.text(max_size=20)), max_size=5))
def test_as_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for text, ids in zip(texts, bpe.encode_texts(texts, bpe.default_ranks())):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert bpe.decode_ids(ids, bpe.default_ranks()).decode() == text


def test_long_slices():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh"), 5000))
    assert np.frombuffer(bpe.encode_texts([text], bpe.default_ranks())[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_operator(docs, none):
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in rows) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_offsets(docs):
    row = bpe.encode(docs.where("doc_id = 6")).first()
    text = docs.where("doc_id = 6").first()["text"].encode()
    at, part = bpe.decode_span(bytes(row["ids"]), bytes(row["offsets"]), 3, 6, bpe.default_ranks())
    assert text[at : at + len(part)] == part and part


def test_query_as_the_library(spark):
    from tallymill.llm.queries import op4_bpe_roundtrip

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4_bpe_roundtrip(spark, sf).collect()} == want


def test_long_text_and_round_trip(spark, docs):
    long = "don't stop — 漢字 42  times\n\n" * 60_000  # several batches' size
    rows = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(rows).collect()}
    assert bytes(got[1]["decoded"]).decode() == long and np.frombuffer(got[1]["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(long) and got[2]["n_tokens"] == 0
    both = lambda df: sorted((r["doc_id"] or -1, r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert both(bpe.round_trip(docs)) == both(bpe.decode(bpe.encode(docs)))


def test_scan_is_the_automaton():
    """The blocked scan at every length around block edges, against one step at a time."""
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 4095, 4096, 4097, 9000):
        kinds = rng.integers(0, 12, n).astype(np.uint8)
        state, want = bpe.START, []
        for k in kinds.tolist():
            state = bpe._step(k, state)
            want.append(state)
        assert bpe.states_after(kinds).tolist() == want
