"""The classifier's fit on the driver: its products agree with a dense matrix, its memory stays near the bytes of its lists."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from strata.llm import toxicity


def test_sparse_products_agree_with_dense_ones():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 9, 50)
    signed = rng.integers(1, 20, lengths.sum()) * rng.choice([-1, 1], lengths.sum())
    dense = np.zeros((50, 20))
    np.add.at(dense, (np.repeat(np.arange(50), lengths), np.abs(signed) - 1), np.sign(signed))
    once = toxicity.Lists.of(signed.astype(np.int32), lengths, False)
    w, r = rng.normal(size=20), rng.normal(size=50)
    assert np.allclose(once.times(w), dense @ w)
    assert np.allclose(once.back(r, 20), dense.T @ r)
    plain = toxicity.Lists.of(np.abs(signed).astype(np.int32), lengths, True)
    assert np.allclose(plain.times(np.append(w, 2.0)), np.bincount(np.repeat(np.arange(50), lengths), w[np.abs(signed) - 1], 50) + 2.0)
    assert plain.back(r, 21)[-1] == r.sum()


def test_fit_holds_few_bytes_an_entry():
    rng = np.random.default_rng(5)
    rows, each = 4000, 1000  # 16 MB of lists as they arrive
    signed = rng.integers(1, 5001, rows * each).astype(np.int32)
    tracemalloc.start()
    x = toxicity.Lists.of(signed, np.full(rows, each), True)
    none = toxicity.Lists.of(np.zeros(0, np.int32), np.zeros(0, np.int64), False)
    toxicity.solve(x, (np.arange(rows) % 2).astype(float), none, np.append(np.ones(5000), 0.0), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_a_sent_model_holds_columns_only():
    model = toxicity.Model(0.5, pa.array([f"word{i}" for i in range(50_000)]), np.zeros(50_000))
    model.logit({"word1"})
    assert len(pickle.dumps(model)) < 1_100_000
    assert pickle.loads(pickle.dumps(model)).logit({"word7", "other"}) == 0.5
