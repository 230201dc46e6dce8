import hashlib
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lacuna.functions import canonical as c
from lacuna.plans.catalog import fingerprint_text

VECTORS = [
    (True, "a753bb2ce0fd9a974baf1194e873f601c9a8f27736eacfd5cba0eaaf6b7da23b"),
    (1, "dd4f6651b9dae1ada52aca66bd7437597424b2bacd40e7c2f593fb9eac158755"),
    ("true", "8cf3eab278a1e829cb963d0c4a567260ef9e1fe2dceb5697bdcc9ddf0e7ad70b"),
    ("1:int", "d0a11ba478691aa137c774b28556aea7b3c9e77fe124ec2f5aee547b39b25734"),
    (None, "0b160d4bfe0884efcf737e657bd50145e71235a45ed21d4d5d9f5869eef7d873"),
    (1.5, "a296591d3c7a9a436af65e6ce779337129811a0b566ef659845c1a1902c66937"),
    (-0.0, "14abee7d73e89d3eb9a5dda93d9642b260b243e6b2dc364832b2040c7dfc96ab"),
    (Fraction(1, 2), "6360aa29d2fce81112db4e286ec7bd8565e8bbdb1a3e90b45db427a7dc7c0fb1"),
]


@pytest.mark.parametrize("value,want", VECTORS)
def test_published_digests(value, want):
    assert c.digest({"v": value}) == want


def test_catalog_is_pinned():
    assert hashlib.sha256(fingerprint_text().encode()).hexdigest() == "b9fd0870e4eb97ffdd49d5fd6f186d487e991f49761cde41877b14a6f15edd16"


def test_decimals():
    assert [c.float8(x) for x in (0.000000015, 1e15 / 3, -1e-9, float("inf"), float("-inf"), float("nan"))] == ["0.00000001", "333333333333333.31250000", "-0.00000000", "inf", "-inf", "nan"]


def test_versions_differ_on_strings_only():
    assert c.canonical({"b": [1, 2.0, None, True], "a": "x\r\ny"}, "1") == {"a": "x\r\ny", "b": ["1:int", "2.00000000", "null", "true"]}
    assert c.canonical("e\u0301\r\nx") == "s:\u00e9\nx"
    assert c.canonical(b"x", "1") == "b'x'"
    with pytest.raises(TypeError):
        c.canonical(b"x")


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"a":NaN}', "{", '{"a":Infinity}'])
def test_strict_json_refuses(bad):
    with pytest.raises(ValueError):
        c.strict_json(bad)


plain = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(plain, plain)
def test_different_values_have_different_forms(a, b):
    norm = lambda v: [norm(x) for x in v] if isinstance(v, list) else {k: norm(x) for k, x in v.items()} if isinstance(v, dict) else (type(v).__name__, c._text(v) if isinstance(v, str) else v)
    if norm(a) != norm(b):
        assert c.digest({"v": a}) != c.digest({"v": b})


def test_udfs_match_functions(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1.5, "b": [null]}',), ("{",)], "t string")
    assert [r[0] for r in rows.select(c.digest_udf()("t")).collect()] == [c.digest({"a": 1}), c.digest({"a": 1.5, "b": [None]}), None]
    assert rows.limit(1).select(c.hmac_udf(b"k")("t")).first()[0] == c.keyed(b"k", '{"a": 1}')
    assert spark.createDataFrame([("a\u200bb\n",)], "t string").select(c.escape_udf()("t")).first()[0] == "a\\u200bb\\n"
