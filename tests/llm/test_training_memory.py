"""Training holds the n-grams of its texts once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from mirrorcheck.llm import toxicity as tx
from mirrorcheck.llm.arrow_text import slices


def test_ngrams_are_held_once():
    texts = [" ".join(f"w{i * j % 977}x{j}" for j in range(400)) for i in range(1, 4001)]
    tracemalloc.start()
    ids, bounds, of_text = tx._bags(texts, tx.Settings())
    # the array reserves a place for every byte and size, which is more than the n-grams; a second copy would come on top
    most = 4 * len(tx.Settings().sizes) * (sum(map(len, texts)) + 2 * len(texts) + 1)
    assert tracemalloc.get_traced_memory()[1] < 1.45 * most
    tracemalloc.stop()
    parts = [tx.features(pa.array(texts[i:i + 32], pa.string()), tx.Settings())[0] for i in range(0, len(texts), 32)]
    assert (ids == np.concatenate(parts)).all() and bounds[-1] == len(ids) and of_text[-1] == len(bounds) - 1


def test_arrow_texts_train_like_lists():
    texts, labels = ["you bad bad one", "a fine day", "bad é", "", "good words here"], np.array([1, 0, 1, 0, 0])
    few = tx.Settings(buckets=1 << 8, epochs=3)
    a, b = tx.fit(texts, labels, 0.2, few), tx.fit(pa.chunked_array([texts[:2], texts[2:]], pa.string()), labels, 0.2, few)
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all()


def test_a_task_scores_few_texts_at_once():
    few = tx.Settings()
    model = tx.Model(few, np.zeros((few.buckets, few.size), np.float32), np.zeros((2, few.size), np.float32), np.zeros(2), 0.1)
    batch = pa.record_batch([[" ".join(f"w{i * j % 977}x{j}" for j in range(400)) for i in range(600)]], ["text"])
    tracemalloc.start()
    scores = np.concatenate([model.score(x.column("text")) for x in slices(iter([batch]), tx.AT_ONCE)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scores == model.score(batch.column("text"))).all()
    assert peak < 120_000_000
