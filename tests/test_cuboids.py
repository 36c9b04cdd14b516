import pytest

from starprism.cube.cuboid import Lattice
from starprism.cube.model import COUNT, CubeDesc, Join, Lookup, Measure, RowKey, StarModel, problems, validated
from starprism.cube.types import DataType

KEYS = "cal_dt leaf meta l2 l3 fmt site seg".split()


def lattice(keys, groups):
    name = lambda c: f"f.{c}"
    return Lattice(CubeDesc("c", StarModel("m", "f"), tuple(RowKey(name(k), i == 0) for i, k in enumerate(keys)), (Measure("n", COUNT),), tuple(tuple(map(name, g)) for g in groups), (("f.meta", "f.l2", "f.l3"),)))


PLAIN = lattice(KEYS, [["fmt", "site", "seg"], ["leaf", "meta", "l3", "l2", "fmt"]])
SELLER = lattice(["seller", *KEYS], [["leaf", "meta", "l2", "l3", "cal_dt"]])
bits = lambda s: int(s, 2)


def test_validity():
    assert all(SELLER.is_valid(bits(s)) for s in "111111111 111111000 110000111 110111000 111110111".split())
    assert not any(SELLER.is_valid(bits(s)) for s in "0 011111110 100000000 111110001 111110100 110000100".split())
    assert all(PLAIN.is_valid(bits(s)) for s in "11111111 10000111 10000001 10000101 10100000 10110000 10111000".split())
    assert not any(PLAIN.is_valid(bits(s)) for s in "0 10001111 11001111 10001000 10011000".split())
    with pytest.raises(ValueError, match="out of"):
        PLAIN.is_valid(bits("111111111"))


@pytest.mark.parametrize(("wanted", "found"), [("00000000", "10000001"), ("00000001", "10000001"), ("00000010", "10000010"), ("00100000", "10100000"), ("01001000", "11111000"), ("01000111", "11111111"), ("11111111", "11111111")])
def test_translation(wanted, found):
    assert PLAIN.translate(bits(wanted)) == bits(found)


@pytest.mark.parametrize(("wanted", "found"), [("0", "100100000"), ("1", "100000111"), ("010", "100000111"), ("0100000", "100100000"), ("1001000", "101111000"), ("1000111", "101000111"), ("111111111", "111111111")])
def test_translation_with_seller(wanted, found):
    assert SELLER.translate(bits(wanted)) == bits(found)


def test_smaller_siblings():
    for c, want in ((255, []), (133, [131]), (127, []), (134, [131, 133]), (130, [129]), (5, []), (135, [])):
        assert PLAIN.smaller_siblings(c) == want
    for c, want in ((511, []), (bits("110111111"), [383]), (bits("101110111"), [319]), (bits("111111000"), []), (bits("110000000"), [288, 320])):
        assert SELLER.smaller_siblings(c) == want


def test_build_levels():
    assert [len(x) for x in PLAIN.levels()] == [1, 4, 6, 6, 4, 4, 2] and [len(x) for x in SELLER.levels()] == [1, 4, 7, 8, 7, 4]
    assert PLAIN.children(248) == []
    for tree in (PLAIN, SELLER):
        built = [c for level in tree.levels() for c, _ in level]
        assert sorted(built) == sorted(tree.valid) and all(tree.is_valid(c) for c in built)
        assert all(p & c == c for level in tree.levels()[1:] for c, p in level)


def test_hierarchy_levels_above_a_wanted_one_need_no_aggregation():
    assert PLAIN.extra_columns(bits("10011000"), bits("10111000")) == 0
    assert PLAIN.extra_columns(bits("10100000"), bits("10110000")) != 0


def test_rules():
    star = StarModel("m", "f", (Lookup("d", Join("inner", ("f.k",), ("d.k",))),))
    good = CubeDesc("c", star, (RowKey("f.k"), RowKey("f.x")), (Measure("n", COUNT), Measure("s", "SUM", ("f.v",), "double")), (("f.k", "f.x"),), derived={"d": ("d.name",)})
    assert problems(good) == [] and CubeDesc.from_json(good.to_json()) == good
    from dataclasses import replace

    bad = {
        "COUNT measures": replace(good, measures=()), "mandatory": replace(good, row_key=(RowKey("f.k", True), RowKey("f.x"))), "fewer than": replace(good, row_key=tuple(RowKey(f"f.c{i}") for i in range(20)), groups=(tuple(f"f.c{i}" for i in range(20)),), derived={}),
        "dictionary or a length": replace(good, row_key=(RowKey("f.k", length=8), RowKey("f.x"))), "cannot return": replace(good, measures=(*good.measures, Measure("t", "SUM", ("f.v",), "string"))), "sketch measure": replace(good, measures=(*good.measures, Measure("h", "COUNT_DISTINCT", ("f.v",), "bigint"))),
        "isn't": None, "aren't in the row key": replace(good, groups=(("f.zz",),)), "is no lookup": replace(good, derived={"zz": ("zz.a",)}), "not joined to the fact": replace(good, model=StarModel("m", "f", (Lookup("d", Join("inner", ("e.k",), ("d.k",))),)), derived={}),
    }
    for text, cube in bad.items():
        if cube is not None:
            assert any(text in p for p in problems(cube)), text
            with pytest.raises(ValueError, match="cube c"):
                validated(cube)


def test_types():
    assert str(DataType.parse("DECIMAL(19,4)")) == "decimal(19,4)" and DataType.parse("decimal").precision == 38 and DataType.parse("long") == DataType.parse("bigint")
    assert DataType.parse("hllc(12)").is_sketch
    assert DataType.parse("int").is_integer and DataType.parse("real").is_number and not DataType.parse("varchar(20)").is_number
    for text in ("hllc(9)", "list", "varchar(x)"):
        with pytest.raises(ValueError):
            DataType.parse(text)
    for text in ("datetime", "binary"):
        with pytest.raises(ValueError, match="queried"):
            DataType.parse(text).spark()
