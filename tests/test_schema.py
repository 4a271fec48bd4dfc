import random

import pytest
from pyspark.sql import types as T

from loomstat.functions import schema as S


def test_parse_marks_nullable_fields():
    s = S.parse("a:int, b:string?,c: double")
    assert s.simpleString() == "struct<a:int,b:string,c:double>"
    assert [f.nullable for f in s] == [False, True, False]


@pytest.mark.parametrize("text", ["a", "a:int:long", "a:thing", "a:int, a:long", "", ":int"])
def test_parse_rejects(text):
    with pytest.raises(ValueError):
        S.parse(text)


def test_random_schemas_survive_json():
    rng = random.Random(7)
    names = list(S.PRIMITIVES)
    for _ in range(50):
        fields = [S.field(f"f{i}", rng.choice(names), nullable=rng.random() < 0.5) for i in range(rng.randint(1, 12))]
        fields.append(S.field("e", "enum", values=["x", "y"], default="y"))
        s = S.schema(fields)
        assert S.from_json(S.to_json(s)) == s


@pytest.mark.parametrize("kind,bad", [("int", "x"), ("int", 1.5), ("string", 3), ("boolean", 1), ("double", "1"), ("int", True)])
def test_default_must_fit_type(kind, bad):
    with pytest.raises(ValueError):
        S.field("f", kind, default=bad)


def test_enum_default_must_be_listed():
    with pytest.raises(ValueError):
        S.field("f", "enum", values=["a", "b"], default="c")


def test_editing():
    base = S.parse("a:int, b:int, c:double, e:string")
    assert S.minus(base, "b", "e").names == ["a", "c"]
    assert S.subset(base, "b", "e").names == ["b", "e"]
    right = S.parse("b:string, f:double, h:string")
    joined = S.joint(base, right)
    assert joined.names == ["a", "b", "c", "e", "f", "h"]
    assert joined["b"].dataType == T.IntegerType()
    assert S.superset(base, S.field("f", "double"), S.field("h", "string")).names == ["a", "b", "c", "e", "f", "h"]
    with pytest.raises(ValueError):
        S.superset(base, S.field("a", "int"))
    with pytest.raises(ValueError):
        S.minus(base, "nope")
    clone = S.clone_field(base["a"], "z", nullable=True)
    assert (clone.name, clone.dataType, clone.nullable) == ("z", T.IntegerType(), True)


def test_conform_fills_only_absent_columns(rows):
    df = rows.of([("foo",), (None,)], "foo string")
    target = S.schema(
        [
            S.field("foo", "string", nullable=True, default="never used"),
            S.field("a", "int", default=10),
            S.field("b", "double", default=100),
            S.field("e", "boolean", default=True),
            S.field("f", "long", default=100),
            S.field("g", "bytes", default=b"\x01\xff"),
            S.field("h", "long", nullable=True),
        ]
    )
    got = rows.sorted(S.conform(df, target))
    tail = (10, 100.0, True, 100, bytearray(b"\x01\xff"), None)
    assert got == sorted([("foo", *tail), (None, *tail)], key=repr)


def test_conform_drops_and_adds(rows):
    df = rows.of([(None, 1.5, "x", True)], "a int, b double, c string, e boolean")
    got = S.conform(df, S.parse("b:double?, e:boolean?, h:long?"))
    assert rows.sorted(got) == [(1.5, True, None)]


def test_conform_rejects_missing_required_and_other_type(rows):
    df = rows.of([(1,)], "a int")
    with pytest.raises(ValueError):
        S.conform(df, S.parse("a:int, b:int"))
    with pytest.raises(ValueError):
        S.conform(df, S.parse("a:long"))


def test_aliases_line_up_keys(rows):
    df = S.alias_fields(rows.of([(1, 2)], "my_country int, x int"), {"my_country": "country"})
    assert df.columns == ["country", "x"]
    with pytest.raises(ValueError):
        S.alias_fields(df, {"gone": "z"})
