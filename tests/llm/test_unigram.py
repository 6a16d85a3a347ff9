import random

import public_tokenizers as P
from tokenizers import Tokenizer, models, pre_tokenizers

from quire.llm.queries import op3_token_counts
from quire.llm.unigram import Counter, count_tokens, read_pieces

PATH = P.path("piece_bpe_32k.model")


def library(pieces, fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


def test_counts_equal_the_library():
    pieces = read_pieces(PATH)
    ours, theirs = Counter(pieces), library(pieces, True)
    rng = random.Random(5)
    texts = ["", " ", "  two  spaces ", "▁marks▁ in", "a\nb\tc", "漢字 🎉🎉 ́", "x" * 500, "the quick brown fox", "    indented     text", "a    b", "▁▁x ▁ y", " " * 70, "end   "]
    texts += ["".join(rng.choices("abcdeéß漢🎉 \n'1.▁", k=rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert ours.text(t)[0] == len(theirs.encode(t, add_special_tokens=False).ids), t


def test_ties_and_unknowns_equal_the_library():
    rng = random.Random(7)
    for trial in range(60):
        words = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0)] + [(w, float(-rng.randint(1, 3))) for w in sorted(words)]
        ours, theirs = Counter(pieces), library(pieces, False)
        for _ in range(30):
            t = "".join(rng.choices("abcd ", k=rng.randint(1, 20)))
            assert ours.text(t)[0] == len(theirs.encode(t, add_special_tokens=False).ids), (pieces, t)


def test_query_and_edges(spark, tmp_path):
    rows = [(1, "Hello  world", "x"), (2, None, None), (3, "", "y"), (None, "null id", "z"), (1, "Hello  world", "x"), (4, "long " * 30000, "q")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_token_counts(spark, str(tmp_path)).collect()
    theirs = library(read_pieces(PATH), True)
    want = sorted(len(theirs.encode(r[1] or "").ids) for r in rows)
    assert sorted(r.n_tokens for r in got) == want
    assert count_tokens(spark.createDataFrame([], "text string"), PATH).count() == 0
