"""Kernel features against the exact kernel."""

import numpy as np
import pytest

from pressmark.operators import kernel_map


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(values)],
                                 "doc_id bigint, features_array array<double>")


def test_features_give_the_kernel_back(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    rows = frame(spark, [*x, None, x[0]])
    model = kernel_map.fit_kernel_map(rows, gamma=0.2, target=0.02)
    assert model.error <= 0.02 and len(model.landmarks) < 150
    out = model.transform(rows).orderBy("doc_id").collect()
    assert out[300]["features"] is None and out[301]["features"] == out[0]["features"]
    z = np.array([r["features"].toArray() for r in out[:300]])
    exact = kernel_map.rbf(x, x, 0.2)
    off = np.linalg.norm(z @ z.T - exact) / np.linalg.norm(exact)
    assert off <= 0.03
    told = model.error_over(rows.where("doc_id < 300"), x).first()
    assert told["n"] == 300 and abs(told["error"] - off) < 1e-9


def test_more_landmarks_less_error_and_few_rows(spark):
    x = np.random.default_rng(2).normal(size=(200, 8))
    loose, tight = (kernel_map.fit_kernel_map(frame(spark, x), 0.05, t) for t in (0.5, 0.0))
    assert len(loose.landmarks) < len(tight.landmarks) == 100 and tight.error < loose.error
    one = kernel_map.fit_kernel_map(frame(spark, x[:1]), 0.5)
    assert one.error < 1e-9
    with pytest.raises(ValueError):
        kernel_map.fit_kernel_map(frame(spark, [None]), 0.5)
