"""Driver-side descriptions: attributes, dataset metadata and model specifications.

Nothing here grows with the data. An attribute list is as long as the table is wide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REAL = "r"
NOMINAL = "n"
INPUT = "i"
OUTPUT = "o"

ATTRIBUTE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("io", T.StringType(), False),
        T.StructField("range_min", T.DoubleType(), False),
        T.StructField("range_max", T.DoubleType(), False),
        T.StructField("values", T.ArrayType(T.StringType(), False), False),
    ]
)


@dataclass(frozen=True)
class Attribute:
    """One column of a labelled set.

    ``range_min``/``range_max`` are the *declared* range of a real attribute, and 0 and
    the last code of a nominal one. ``values`` is the ordered domain of a nominal one.
    """

    name: str
    kind: str
    io: str
    range_min: float
    range_max: float
    values: tuple[str, ...] = ()


def real(name: str, low: float, high: float) -> Attribute:
    """A real input attribute with its declared range."""
    return Attribute(name, REAL, INPUT, float(low), float(high))


def nominal(name: str, values) -> Attribute:
    """A nominal input attribute; the code of a value is its position in ``values``."""
    values = tuple(values)
    if not values:
        raise ValueError(f"nominal attribute {name!r} declares no value")
    return Attribute(name, NOMINAL, INPUT, 0.0, float(len(values) - 1), values)


def class_attributes(classes, kind: str = NOMINAL) -> tuple[Attribute, ...]:
    """The single output, expanded to one binary attribute per class.

    Only the first keeps the kind of the declared output, which is ``'r'`` when a real
    output was accepted; the others are always nominal.
    """
    return tuple(
        Attribute(str(c), kind if i == 0 else NOMINAL, OUTPUT, 0.0, 1.0, ("0", "1"))
        for i, c in enumerate(classes)
    )


@dataclass(frozen=True)
class DatasetMeta:
    """Everything known about a labelled set before its rows are read."""

    inputs: tuple[Attribute, ...]
    classes: tuple
    output_kind: str = NOMINAL

    @property
    def attributes(self) -> tuple[Attribute, ...]:
        return self.inputs + class_attributes(self.classes, self.output_kind)

    @property
    def n_input(self) -> int:
        return len(self.inputs)

    @property
    def n_output(self) -> int:
        return len(self.classes)

    @property
    def n_attributes(self) -> int:
        return self.n_input + self.n_output

    def attribute_table(self, spark: SparkSession) -> DataFrame:
        """The attribute list as a table (one row per attribute, in order)."""
        rows = [
            (i, a.name, a.kind, a.io, a.range_min, a.range_max, list(a.values))
            for i, a in enumerate(self.attributes)
        ]
        return spark.createDataFrame(rows, ATTRIBUTE_SCHEMA)


MODEL_CODES = ("NB", "LR", "DT")


@dataclass(frozen=True)
class ModelSpec:
    """A model code and its arguments.

    ``NB`` takes ``smoothing``; ``LR`` takes ``num_classes``; ``DT`` takes
    ``num_classes``, ``max_depth`` and ``max_bins``. ``num_classes`` is a lower bound: a
    set with more classes wins.
    """

    code: str
    num_classes: int = 0
    smoothing: float = 1.0
    max_depth: int = 5
    max_bins: int = 32

    def __post_init__(self):
        if self.code not in MODEL_CODES:
            raise ValueError(f"unknown model code {self.code!r}; use one of {MODEL_CODES}")
        if self.smoothing < 0:
            raise ValueError("smoothing must not be negative")
        if self.num_classes < 0 or self.max_depth < 0 or self.max_bins < 2:
            raise ValueError(f"bad arguments for {self.code}")

    @classmethod
    def of(cls, code: str, *args) -> "ModelSpec":
        """``of("NB", 1.0)``, ``of("LR", 3)``, ``of("DT", 3, 5, 32)``."""
        if code == "NB":
            (smoothing,) = args or (1.0,)
            return cls(code, smoothing=float(smoothing))
        if code == "LR":
            (num_classes,) = args or (0,)
            return cls(code, num_classes=int(num_classes))
        if code == "DT":
            num_classes, max_depth, max_bins = args or (0, 5, 32)
            return cls(code, int(num_classes), 1.0, int(max_depth), int(max_bins))
        return cls(code)

    def describe(self, smoothing: float | None = None) -> str:
        """The specification as one report line, in the order the arguments are given; the
        smoothing that took the place of the argument comes first, and what was asked after it."""
        if self.code == "NB":
            if smoothing is None or smoothing == self.smoothing:
                return f"NB {self.smoothing}"
            return f"NB {smoothing} (asked {self.smoothing})"
        if self.code == "LR":
            return f"LR {self.num_classes}"
        return f"DT {self.num_classes} {self.max_depth} {self.max_bins}"


def require_specs(level0, level1=None, stacking: bool = False) -> None:
    """An ensemble needs two or more level-0 models; stacking also a level-1 model."""
    if len(level0) < 2:
        raise ValueError("an ensemble needs at least two level-0 models")
    if stacking and level1 is None:
        raise ValueError("stacking needs a level-1 model")


@dataclass(frozen=True)
class Dataset:
    """A labelled set: a lazy DataFrame plus its metadata.

    ``frame`` holds the key columns, then ``inputs`` (raw values and codes), ``outputs``
    (one-hot class), ``features`` (``inputs`` after the declared-range rescale) and
    ``label``. Columns a job does not touch are never computed.
    """

    frame: DataFrame
    meta: DatasetMeta
    key: tuple[str, ...]
    name: str = ""
    raw: DataFrame | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession
