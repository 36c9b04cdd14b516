"""Star models and cube descriptions, with the rules that they must obey."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from starprism.cube.types import DataType

LARGEST_GROUP = 20  # an aggregation group must be smaller
SUM, COUNT, MIN, MAX, DISTINCT = "SUM", "COUNT", "MIN", "MAX", "COUNT_DISTINCT"


def physical(column: str) -> str:
    """Name of ``table.column`` in flat tables and cuboids."""
    return column.replace(".", "__")


@dataclass(frozen=True)
class Join:
    """The fact table's keys and a lookup's, as table.column, in the same order."""

    kind: str  # inner or left
    fact_keys: tuple[str, ...]
    lookup_keys: tuple[str, ...]

    def __post_init__(self):
        if self.kind not in ("inner", "left"):
            raise ValueError(f"a star joins by inner or left, not {self.kind}")
        if len(self.fact_keys) != len(self.lookup_keys) or not self.fact_keys:
            raise ValueError("a join needs as many keys on either side")

    @property
    def pairs(self) -> frozenset[tuple[str, str]]:
        return frozenset(zip(self.fact_keys, self.lookup_keys, strict=True))


@dataclass(frozen=True)
class Lookup:
    table: str
    join: Join


@dataclass(frozen=True)
class StarModel:
    """One fact table and its lookups. ``partition``: the fact's date column by which segments are cut, and ``start``,
    where the first segment begins (ISO date)."""

    name: str
    fact: str
    lookups: tuple[Lookup, ...] = ()
    condition: str | None = None
    partition: str | None = None
    start: str = "1970-01-01"

    def lookup(self, table: str) -> Lookup:
        return next(x for x in self.lookups if x.table == table)

    @property
    def tables(self) -> list[str]:
        return [self.fact, *(x.table for x in self.lookups)]


@dataclass(frozen=True)
class Measure:
    """``args``: columns, or none for COUNT(1). ``returns``: hllc(p) for stored sketches; bigint with ``of``, another
    measure, for a distinct count that is kept as a number and so cannot be merged."""

    name: str
    func: str
    args: tuple[str, ...] = ()
    returns: str = "bigint"
    of: str | None = None

    @property
    def holistic(self) -> bool:
        return self.func == DISTINCT and not DataType.parse(self.returns).is_sketch


@dataclass(frozen=True)
class RowKey:
    column: str
    mandatory: bool = False
    dictionary: bool = True
    length: int = 0


@dataclass(frozen=True)
class CubeDesc:
    """``row_key`` runs from the highest bit down. ``hierarchies``: columns from the top level down. ``derived``: columns
    of a lookup that aren't stored and come from its snapshot by the join key. ``expressions``: columns computed while
    flattening, as name to SQL over table.column."""

    name: str
    model: StarModel
    row_key: tuple[RowKey, ...]
    measures: tuple[Measure, ...]
    groups: tuple[tuple[str, ...], ...] = ()
    hierarchies: tuple[tuple[str, ...], ...] = ()
    derived: dict[str, tuple[str, ...]] = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)

    @property
    def dimensions(self) -> list[str]:
        return [k.column for k in self.row_key]

    def host_of(self, column: str) -> Lookup | None:
        """The lookup from which a derived column comes."""
        return next((self.model.lookup(t) for t, cols in self.derived.items() if column in cols), None)

    def key_as_dimension(self, column: str) -> str | None:
        """A lookup's key that equals a dimension of the fact table."""
        for lookup in self.model.lookups:
            for fk, pk in lookup.join.pairs:
                if column == pk and fk in self.dimensions:
                    return fk
        return None

    @property
    def holistic(self) -> bool:
        return any(m.holistic for m in self.measures)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> CubeDesc:
        d = json.loads(text)
        m = d["model"]
        lookups = tuple(Lookup(x["table"], Join(x["join"]["kind"], tuple(x["join"]["fact_keys"]), tuple(x["join"]["lookup_keys"]))) for x in m["lookups"])
        deep = lambda xs: tuple(map(tuple, xs))
        return cls(
            d["name"], StarModel(**{**m, "lookups": lookups}), tuple(RowKey(**k) for k in d["row_key"]), tuple(Measure(**{**x, "args": tuple(x["args"])}) for x in d["measures"]), deep(d["groups"]), deep(d["hierarchies"]),
            {k: tuple(v) for k, v in d["derived"].items()}, d["expressions"],
        )


def problems(cube: CubeDesc) -> list[str]:
    """What is wrong with a description; nothing if it can be built."""
    out, known = [], set(cube.dimensions)
    mandatory = {k.column for k in cube.row_key if k.mandatory}
    for group in cube.groups:
        if len(group) >= LARGEST_GROUP:
            out.append(f"a group of {len(group)} columns; fewer than {LARGEST_GROUP} are allowed")
        if clash := mandatory.intersection(group):
            out.append(f"mandatory columns in a group: {sorted(clash)}")
        if missing := set(group) - known:
            out.append(f"group columns that aren't in the row key: {sorted(missing)}")
    if len(known) != len(cube.row_key):
        out.append("a column stands twice in the row key")
    for key in cube.row_key:
        if key.dictionary == bool(key.length):
            out.append(f"{key.column} needs either a dictionary or a length")
    counts = [m for m in cube.measures if m.func == COUNT]
    if len(counts) != 1:
        out.append(f"{len(counts)} COUNT measures; there must be one")
    if len({m.name for m in cube.measures}) != len(cube.measures):
        out.append("two measures of one name")
    names = {m.name: m for m in cube.measures}
    for m in cube.measures:
        kind = DataType.parse(m.returns)
        good = {SUM: kind.is_number, MIN: kind.is_number, MAX: kind.is_number, COUNT: kind.is_integer, DISTINCT: kind.is_sketch or kind.is_integer}
        if not good.get(m.func, False):
            out.append(f"{m.name}: {m.func} cannot return {m.returns}")
        if m.func != COUNT and not m.args:
            out.append(f"{m.name}: {m.func} needs a column")
        if m.holistic and not (m.of in names and DataType.parse(names[m.of].returns).is_sketch):
            out.append(f"{m.name}: a distinct count kept as a number needs a sketch measure to come from")
    for levels in cube.hierarchies:
        if missing := set(levels) - known:
            out.append(f"hierarchy levels that aren't in the row key: {sorted(missing)}")
    for table, columns in cube.derived.items():
        if table not in cube.model.tables[1:]:
            out.append(f"{table} is no lookup, so nothing derives from it")
        elif not set(cube.model.lookup(table).join.fact_keys) <= known:
            out.append(f"columns {list(columns)} derive from keys that aren't in the row key")
    for lookup in cube.model.lookups:
        if any(k.split(".")[0] != cube.model.fact for k in lookup.join.fact_keys):
            out.append(f"{lookup.table} is not joined to the fact table")
    return out


def validated(cube: CubeDesc) -> CubeDesc:
    if found := problems(cube):
        raise ValueError(f"cube {cube.name}: " + "; ".join(found))
    return cube
