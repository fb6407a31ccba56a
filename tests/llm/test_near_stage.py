import random


def test_near_stage_rewrapped(spark):
    """A copy wrapped and edited goes by five-word shingles, though its lines and its fingerprint differ; pairs are those of brute force."""
    import corpus_pipeline as p

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [base]
    for edits in (3, 4, 5, 6, 7, 8, 20):
        words = list(base)
        for k in rng.sample(range(0, 300, 12), edits):
            words[k] = f"Other{k}"
        texts.append(words)
    texts += [[f"v{rng.randrange(5000)}" for _ in range(300)], ["one", "two"]]
    wrapped = ["\n".join(" ".join(ws[k : k + 9 + n]) for k in range(0, len(ws), 9 + n)) for n, ws in enumerate(texts)]
    grams = [{tuple(x.lower() for x in ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} for ws in texts]
    gone = {b for b in range(len(texts)) for a in range(b) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert len(gone) > 2 and len(gone) < 8
    near = p.near(spark, spark.createDataFrame(list(enumerate(wrapped)), "doc_id long, text string"), "")
    assert {(r.doc_id, r.text) for r in near.collect()} == {(k, t) for k, t in enumerate(wrapped) if k not in gone}
