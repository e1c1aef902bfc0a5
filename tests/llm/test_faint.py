from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from plumbline.llm.subjects import _update


def test_many_faint_terms_outweigh_a_clear_one():
    faint = 500
    profiles = np.array([[1.0, 0.1]] + [[0.1, 1.0]] * faint + [[1.0, 1.0]])
    weight = np.array([0.05] + [1e-3] * faint + [0.0])
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([list(range(faint + 2))], pa.list_(pa.int32()))], ["labels", "terms"])
    (got,) = _update(2, SimpleNamespace(value=(len(weight), profiles, weight, 1.0)))(iter([batch]))
    last = got.to_pylist()[-1]  # the neutral term shows the document's mixture
    assert last["term"] == faint + 1 and last["k1"] > 0.5
