import math
import numbers

import numpy as np


def cell(x):
    if x is None or str(x) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)):
        return None if math.isnan(x) else float(x)
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(cell(x) for x in r)) for r in frame.itertuples(index=False))


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
