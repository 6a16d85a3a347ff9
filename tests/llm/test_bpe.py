import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import regex
import tiktoken

from quire.llm.bpe import NARROW, USUAL, ByteBPE, encode_documents, read_ranks
from quire.llm.queries import op6_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library():
    ours, theirs = ByteBPE(read_ranks(PATH), P.PATTERN), reference()
    rng = random.Random(3)
    texts = ["", " ", "a" * 1000, "ab" * 3000, "don't  stop\n\n now", "Ünïcödé ß 漢字 🎉🎉", "<|endoftext|>", "  x", "1234567 8"]
    texts += ["".join(rng.choices("abcdeéß漢 \n'1.", k=rng.randint(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choices("etaoin", k=rng.randint(60, 600))) for _ in range(20)]
    ids, ends = ours.encode(texts)
    for i, t in enumerate(texts):
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == theirs.encode_ordinary(t), t
        assert ours.decode(np.array(got, int)).tobytes() == t.encode()


def test_ranks_of_pairs_from_the_table():
    bpe = ByteBPE(read_ranks(PATH), P.PATTERN)
    rng = np.random.default_rng(4)
    keys = np.array([*bpe.pairs])
    a, b = np.r_[keys >> 32, rng.integers(-1, 50_000, 200_000)], np.r_[keys & 0xFFFFFFFF, rng.integers(-1, 50_000, 200_000)]
    want = [bpe.pairs.get(x << 32 | y, 1 << 60) if x >= 0 and y >= 0 else 1 << 60 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert (bpe._rank(a, b) == want).all() and len(bpe.keys) >= 4 * len(keys)


def test_pieces_of_every_width_merge_as_alone():
    bpe = ByteBPE(read_ranks(PATH), P.PATTERN)
    rng = random.Random(5)
    pieces = [bytes(rng.choices(b"etaoin " if i % 2 else range(256), k=n)) for n in range(2, 65) for i in range(40)]
    pieces = [p for p in pieces if p not in bpe.ranks]
    assert bpe.merge(pieces) == [bpe._alone(p) for p in pieces]


def test_decoded_slices(spark):
    rows = [(i, "".join(chr(97 + (i * k) % 26) for k in range(i % 7)) if i % 11 else None) for i in range(700)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in got} == {i: (t or "").encode() for i, t in rows}


def test_texts_are_encoded_once_and_handed_on_in_parts(spark):
    import pyarrow as pa

    from quire.llm.bpe import DECODED, coder, parts

    texts = [f"text {i} " * (i % 9) if i % 7 else None for i in range(600)]
    got = list(parts(coder(PATH, P.PATTERN), iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, got)) <= DECODED and [x["decoded"].decode() for x in pa.concat_arrays(got).to_pylist()] == [t or "" for t in texts]
    df = encode_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH, P.PATTERN)
    (calls,) = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert calls.count("(cast") + calls.count("(text") == 1, calls


def test_narrow_pattern_splits_alike():
    slow = regex.compile(USUAL)
    assert USUAL == P.PATTERN
    rng = random.Random(9)
    alphabet = [chr(i) for i in range(0x250)]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=8) + rng.choices(" 's'ta1é\n", k=12))
        assert NARROW.findall(t) == slow.findall(t), t


def test_query_and_edges(spark, tmp_path):
    ref = reference()
    rows = [(1, "Hello  world", "x"), (2, None, None), (3, "", "y"), (None, "null id", "z"), (1, "Hello  world", "x"), (4, "long " * 20000, "q")]
    spark.createDataFrame(rows, "doc_id long, text string, token_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_byte_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next((x[1] for x in rows if x[0] == r.doc_id), None) or ""
        ids = ref.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(none, PATH, P.PATTERN).count() == 0
