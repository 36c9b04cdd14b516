"""The column type grammar and its Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# fixed values: the type names and their other spellings
NAMES = ("any", "char", "varchar", "boolean", "binary", "integer", "tinyint", "smallint", "bigint", "decimal", "numeric", "float", "real", "double", "date", "time", "datetime", "timestamp", "byte", "int", "short", "long", "string", "hllc")
SPELLINGS = {"byte": "tinyint", "short": "smallint", "int": "integer", "long": "bigint", "numeric": "decimal", "real": "float"}
INTEGERS = ("tinyint", "smallint", "integer", "bigint")
NUMBERS = (*INTEGERS, "float", "double", "decimal")

_GRAMMAR = re.compile(rf"\s*({'|'.join(sorted(NAMES, key=len, reverse=True))})\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", re.IGNORECASE)
_SPARK = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "char": T.StringType(), "varchar": T.StringType(), "string": T.StringType(), "hllc": T.BinaryType(), "any": T.BinaryType(), "time": T.StringType()}


@dataclass(frozen=True)
class DataType:
    name: str
    precision: int = -1
    scale: int = -1

    @classmethod
    def parse(cls, text: str) -> DataType:
        found = _GRAMMAR.fullmatch(text)
        if not found:
            raise ValueError(f"bad data type: {text}")
        name = found[1].lower()
        name = SPELLINGS.get(name, name)
        precision, scale = (int(x) if x else -1 for x in found.groups()[1:])
        if name == "decimal" and precision < 0:
            precision, scale = 38, 16  # Spark's widest; the default elsewhere is one digit wider
        elif name == "decimal":
            scale = max(scale, 0)
        elif name in ("char", "varchar") and precision < 0:
            precision = 256
        elif name == "hllc":
            precision = 10 if precision < 0 else precision
            if not 10 <= precision <= 16:
                raise ValueError(f"sketch precision must be 10 to 16: {text}")
        return cls(name, precision, scale)

    @property
    def is_integer(self) -> bool:
        return self.name in INTEGERS

    @property
    def is_number(self) -> bool:
        return self.name in NUMBERS

    @property
    def is_sketch(self) -> bool:
        return self.name == "hllc"

    def spark(self) -> T.DataType:
        """The Spark type; datetime and binary can be declared but not queried."""
        if self.name == "decimal":
            return T.DecimalType(min(self.precision, 38), self.scale)
        if self.name not in _SPARK:
            raise ValueError(f"a column of type {self.name} cannot be queried")
        return _SPARK[self.name]

    def __str__(self) -> str:
        return self.name if self.precision < 0 else f"{self.name}({self.precision}{f',{self.scale}' if self.scale >= 0 else ''})"
