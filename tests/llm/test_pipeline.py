import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quire.llm.privacy import entities


def test_stages_in_order_and_effects(spark):
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "surrogates", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in kept["toxicity"] for d in clean) >= 0.99 * len(clean)
    toxic = [d for d, t in labels.items() if t]
    assert sum(d in kept["toxicity"] for d in toxic) <= 0.4 * len(toxic)
    # Near-duplicates and contained items, by brute force over what the stage before kept.
    sets = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").encode().lower().split())
    s = {d: sets(t) for d, t in kept["toxicity"].items()}
    for d in kept["near_dedup"]:
        assert not any(e < d and s[d] and 100 * len(s[d] & s[e]) >= 75 * len(s[d] | s[e]) for e in kept["near_dedup"])
    items = [sets(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d for d, t in kept["near_dedup"].items() if not any(len(i & sets((t or "").lower())) >= 0.75 * len(i) for i in items)}
    assert set(kept["decontamination"]) == left
    for d, t in kept["surrogates"].items():
        assert (t == texts[d]) == (not entities(texts[d] or ""))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out.collect():
        assert r.token_ids == enc.encode_ordinary(r.text or "") and r.round_trip


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
