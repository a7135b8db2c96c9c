"""What training and long chains of queries leave in the driver."""

import random
import tracemalloc

import numpy as np

from lodestrata import scratch
from lodestrata.llm import langid, near_dedup


def test_training_a_language_model_holds_the_grams_of_one_length():
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    samples = [(f"l{k}", " ".join("".join(rng.choices(letters, k=8)) for _ in range(1500))) for k in range(5)]
    tracemalloc.start()
    model = langid.Model(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in model.grams] == [0, 400, 30_000, 30_000, 30_000]
    # An array for each gram of any length took 67 MB.
    assert peak < 45 << 20
    assert model.words.rows.shape == (len(model.words), 5) and np.shares_memory(model.grams[2].rows, model.gram_rows)


def test_near_dedup_settles_between_its_parts(spark, monkeypatch):
    calls, rng = [], random.Random(3)
    words = [[rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)] for _ in range(8)]
    docs = spark.createDataFrame([(10 * i + j, " ".join([*w, "z" * j])) for i, w in enumerate(words) for j in range(4)], "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "settle", lambda s: calls.append("settle") or scratch.settle(s))
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: calls.append(name) or scratch.store(df, name))
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(10 * i + j, 10 * i) for i in range(8) for j in range(4)]
    # Labels are joined to the prefixes once for each search, and the driver settles before the next.
    at = [i for i, x in enumerate(calls) if x == "labelled"]
    assert len(at) == near_dedup.ROUNDS + 1
    assert all("settle" in calls[a:b] for a, b in zip(at, [*at[1:], len(calls)], strict=True))
