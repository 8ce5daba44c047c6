import random

import pyarrow as pa
import pytest

from scrivel.functions import codec


def test_whole_batches_agree_with_single_rows():
    rng = random.Random(7)
    wide = lambda: rng.choice([0, -1, 63, 64, 127, 128, -(2**63), 2**63 - 1, rng.randint(-300, 300), rng.randint(-(2**62), 2**62)])
    for n in (0, 1, 5, 300):
        rows = [None if rng.random() < 0.1 else [wide() for _ in range(rng.randint(0, 6))] for _ in range(n)]
        for lists in (pa.array(rows, pa.list_(pa.int64())), pa.array(rows, pa.list_(pa.int64())).slice(n // 3)):
            raw = codec._put_all(lists)
            assert raw.to_pylist() == [None if x is None else codec.put_varints(x) for x in lists.to_pylist()]
            assert codec._get_all(raw).to_pylist() == lists.to_pylist()
    # unfinished, padded and empty rows
    odd = [b"\x80", b"\x02\x81", None, b"", b"\x04", b"\x80\x00", b"\x82" * 3]
    for raw in (odd, [*odd, b"\x80" * 12 + b"\x00"]):
        assert codec._get_all(pa.array(raw, pa.binary())).to_pylist() == [None if x is None else codec.get_varints(x) for x in raw]
    with pytest.raises((OverflowError, pa.ArrowInvalid)):
        codec._get_all(pa.array([b"\xff" * 9 + b"\x7f"], pa.binary()))
