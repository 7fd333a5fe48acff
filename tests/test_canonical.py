import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from convoloom.functions.canonical import canonical_hash, canonical_json, number_text


@pytest.mark.parametrize(
    "x, expected",
    [(0, "0"), (-0.0, "0"), (1, "1"), (1.0, "1"), (-1.5, "-1.5"), (100, "100"), (1e21, "1e+21"), (123456789012345680000, "123456789012345680000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (1.7976931348623157e308, "1.7976931348623157e+308"), (5e-324, "5e-324"), (0.1, "0.1"), (12345.678, "12345.678"), (2**53, "9007199254740992")],
)
def test_numbers(x, expected):
    assert number_text(x) == expected


def test_values():
    assert canonical_json({"b": [1, None, True], "a": "\n\"\\\x01é😀", "𐀀": 1, "\uffff": 2}) == '{"a":"\\n\\"\\\\\\u0001é😀","b":[1,null,true],"\uffff":2,"𐀀":1}'
    assert canonical_json("\ud800") == '"\\ud800"'
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError):
            canonical_json(bad)
    with pytest.raises(TypeError):
        canonical_json({1, 2})


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_come_back(x):
    assert float(number_text(x)) == x


@given(st.recursive(st.one_of(st.none(), st.booleans(), st.text(st.characters(exclude_categories=["Cs"])), st.integers(-(2**53), 2**53)), lambda c: st.one_of(st.lists(c), st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), c))))
def test_order_of_members_is_no_matter(v):
    assert json.loads(canonical_json(v)) == v

    def turned(x):
        return {k: turned(x[k]) for k in reversed(list(x))} if isinstance(x, dict) else [turned(y) for y in x] if isinstance(x, list) else x

    assert canonical_hash(turned(v)) == canonical_hash(v)
