"""Later turns of the similarity join read only what may still change."""

import numpy as np

from mirrorcheck.llm import jaccard


def test_only_the_sets_of_the_pairs_are_shuffled(spark):
    body = [np.arange(k, k + 20, dtype="<u8").tobytes() for k in (0, 1, 500)]
    contents = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(body)], "sid long, grams binary")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    found = jaccard._links(pairs, contents, jaccard.Join())
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 1)]


def test_keys_of_one_group_leave(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:-1] + ["y"]), "another text of few words", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, plain = [], jaccard.stored

    def counted(df, *args, **kw):
        out = plain(df, *args, **kw)
        if "lead" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    joined = []
    mixed = jaccard.connected
    monkeypatch.setattr(jaccard, "connected", lambda links: joined.append(links.count()) or mixed(links))
    out = jaccard.similar_groups(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "n_keys" not in plan
    assert {r["doc_id"]: r["first_id"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert sizes[0] > 0 and sizes[-1] == 0 and joined[-1] >= 2
