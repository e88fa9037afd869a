"""Text sets whose header declares the attributes (the public KEEL ``.dat`` layout).

::

    @relation name
    @attribute width real [0.0, 2.5]
    @attribute size {small, large}
    @attribute class {a, b}
    @inputs width, size
    @outputs class
    @data
    0.2, small, a

Header lines are few and are parsed on the driver; rows are parsed by column expressions
only, so a load is one narrow stage however large the file is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import zip_longest
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorum.functions.encode import (
    UNROLL_LIMIT,
    class_onehot,
    label_from_onehot,
    literal_array,
    nominal_code,
    rescale_array,
)
from quorum.operators.sampling import numbered_copies
from quorum.schema import NOMINAL, REAL, Attribute, Dataset, DatasetMeta, nominal, real

# Fixed values of the file format.
REAL_TYPES = ("real", "integer")
ATTRIBUTE_SEPARATOR = r" *[{}\[\],] *| "
LIST_SEPARATOR = r" *, *| +"
HEADER_MARKS = ("@relation", "@attribute", "@inputs", "@outputs", "@data")

_BLANKS = "".join(chr(i) for i in range(33))


def _tokens(separator: str, line: str) -> list[str]:
    parts = re.split(separator, line)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def _attribute_line(line: str) -> tuple[str, bool, tuple[str, ...], tuple[float, float]]:
    words = _tokens(ATTRIBUTE_SEPARATOR, line)
    if len(words) < 3 or "" in words:
        raise ValueError(f"cannot read attribute line: {line!r}")
    name, kind, rest = words[1], words[2], words[3:]
    if kind in REAL_TYPES:
        if len(rest) != 2:
            raise ValueError(f"real attribute needs a range [min, max]: {line!r}")
        return name, True, (), (float(rest[0]), float(rest[1]))
    declared = re.search(r"\{(.*)\}", line)
    if declared and any(" " in v.strip(" ") for v in declared.group(1).split(",")):
        raise ValueError(f"a nominal value may not hold a space: {line!r}")
    return name, False, tuple(words[2:]), (0.0, float(len(words) - 3))


def parse_header(lines: Iterable[str], accept_real_output: bool = True) -> DatasetMeta:
    """Attributes, class list and counts from the header lines, in file order."""
    lines = [line for line in lines if line.startswith("@")]

    def first(prefix: str) -> list[str]:
        for line in lines:
            if line.startswith(prefix):
                return _tokens(LIST_SEPARATOR, line)
        raise ValueError(f"the header has no {prefix} line")

    n_input = len(first("@inputs")) - 1
    outputs = first("@outputs")[1:]
    parsed = [_attribute_line(line) for line in lines if line.startswith("@attribute")]
    if not parsed:
        raise ValueError("the header has no @attribute line")
    roles = [name in outputs for name, *_ in parsed]
    if roles.count(True) != 1 or len(outputs) != 1:
        raise ValueError(f"exactly one output is supported, the header has {outputs}")
    if not roles[-1]:
        raise ValueError(f"the output {outputs[0]!r} must be the last attribute")
    if n_input != len(parsed) - 1:
        raise ValueError(f"@inputs counts {n_input}, the header declares {len(parsed) - 1}")

    inputs = tuple(
        real(name, *span) if is_real else nominal(name, values)
        for name, is_real, values, span in parsed[:-1]
    )
    name, is_real, values, _ = parsed[-1]
    if is_real:
        if not accept_real_output:
            raise ValueError(f"the output {name!r} is real; only nominal classes are supported")
        return DatasetMeta(inputs, ("Void",), REAL)
    return DatasetMeta(inputs, values, NOMINAL)


def header_lines(lines: DataFrame, order_by: str | None = None, value: str = "value") -> DataFrame:
    """The lines that start with ``@``, in order."""
    head = lines.filter(F.col(value).startswith("@"))
    return head.orderBy(order_by) if order_by else head


def data_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines with no ``@`` anywhere that are not blank."""
    text = F.col(value)
    return lines.filter(~text.contains("@") & (F.btrim(text, F.lit(_BLANKS)) != ""))


def _split_row(text: Column) -> Column:
    # Empty fields at the end of a line do not count as fields.
    tail = F.rtrim(text).endswith(",")
    return F.split(F.when(tail, F.regexp_replace(text, "[ ,]+$", "")).otherwise(text), ",")


def _trimmed(token: Column, first: bool, last: bool, trim_ends: bool) -> Column:
    # Spaces around a comma belong to the comma; those at the ends of the line do not.
    if trim_ends or not (first or last):
        return F.trim(token)
    return F.rtrim(token) if first else F.ltrim(token)


def _input_code(token: Column, a: Attribute, first: bool, trim_ends: bool) -> Column:
    if a.kind == REAL:
        return token.try_cast("double")  # a cast trims by itself
    return nominal_code(_trimmed(token, first, False, trim_ends), a.values)


def _input_codes(parts: Column, inputs: Sequence[Attribute], trim_ends: bool) -> Column:
    """Array of input values: NULL for a number that does not parse, -1 for an undeclared
    nominal value."""
    if len(inputs) <= UNROLL_LIMIT:
        return F.array(
            *[_input_code(F.get(parts, F.lit(i)), a, i == 0, trim_ends) for i, a in enumerate(inputs)]
        )
    # One function over the fields, so that the plan and its code do not grow with the width.
    first = _input_code(F.get(parts, F.lit(0)), inputs[0], True, trim_ends)
    rest = F.slice(parts, 2, len(inputs) - 1)
    if all(a.kind == REAL for a in inputs[1:]):
        others = F.transform(rest, lambda token: token.try_cast("double"))
    else:
        domains = F.array(
            *[
                literal_array(a.values) if a.kind != REAL else F.array().cast("array<string>")
                for a in inputs[1:]
            ]
        )
        others = F.zip_with(
            rest,
            domains,
            lambda token, domain: F.when(F.size(domain) == 0, token.try_cast("double")).otherwise(
                (F.coalesce(F.array_position(domain, F.trim(token)), F.lit(0)) - 1).cast("double")
            ),
        )
    return F.concat(F.array(first), others)


def _parsed_fields(
    lines: DataFrame, meta: DatasetMeta, key: Sequence[str], value: str, trim_ends: bool
) -> DataFrame:
    """Key, line, whether the field count is right, input values and class code (or real
    output). Nothing raises here."""
    n = meta.n_input + 1
    rows = data_lines(lines, value).select(*key, F.col(value), _split_row(F.col(value)).alias("_p"))
    parts = F.col("_p")
    token = F.get(parts, F.lit(n - 1))
    if meta.output_kind == REAL:
        output = token.try_cast("double")
    else:
        output = nominal_code(_trimmed(token, False, True, trim_ends), meta.classes)
    return rows.select(
        *key,
        value,
        (F.size(parts) == n).alias("_ok"),
        _input_codes(parts, meta.inputs, trim_ends).alias("_x"),
        output.alias("_c"),
    )


def parse_keel(
    lines: DataFrame,
    meta: DatasetMeta,
    key: Sequence[str] | str | None = None,
    value: str = "value",
    on_bad_row: str = "raise",
    on_zero_range: str = "nan",
    compat: bool = True,
    trim_line_ends: bool | None = None,
    name: str = "",
    report: Observation | None = None,
) -> Dataset:
    """Rows of a text set as a :class:`Dataset`.

    ``key`` names columns of ``lines`` that identify a row. Without it the set has no key:
    runs then draw for every row by itself, also where lines are equal, and write the draws
    down once. ``key="content"`` makes ``row_id`` a digest of the line, so that equal lines
    share their draws; ``key="copy"`` digests the line's number among equal lines as well, so that
    they draw apart and nothing is written down, at the price of one shuffle of the lines. ``on_bad_row="drop"`` leaves out rows that do not parse instead of
    raising (with the line in the message). ``report`` takes the counts of :func:`load_report`
    along in the first action on the whole frame, which saves a second read of the lines.
    """
    if on_bad_row not in ("raise", "drop"):
        raise ValueError("on_bad_row must be 'raise' or 'drop'")
    trim_ends = (not compat) if trim_line_ends is None else trim_line_ends
    source = lines
    if key == "content":
        lines = lines.withColumn("row_id", F.md5(F.col(value)))
        key = ["row_id"]
    elif key == "copy":
        lines = numbered_copies(data_lines(lines, value).select(value))
        lines = lines.withColumn("row_id", F.md5(F.concat_ws("|", "copy", value)))
        key = ["row_id"]
    key = list(key or ())
    rows = _parsed_fields(lines, meta, key, value, trim_ends)
    if report is not None:
        rows = rows.observe(report, *_report_columns(meta, value))
    real_output = meta.output_kind == REAL
    bad_number = F.exists("_x", lambda x: x.isNull())
    bad_class = F.col("_c").isNull() if real_output else F.col("_c") < 0

    if on_bad_row == "drop":
        rows = rows.filter(F.col("_ok") & ~bad_number & ~bad_class)
    else:

        def fail(what: str) -> Column:
            return F.raise_error(F.concat(F.lit(f"{what} in row: "), F.col(value)))

        # One value holds both, so that whatever is read from a row depends on all checks.
        checked = (
            F.when(~F.col("_ok"), fail("wrong number of fields"))
            .when(bad_number, fail("not a number"))
            .when(bad_class, fail("unknown class"))
            .otherwise(F.struct("_x", "_c"))
        )
        rows = rows.select(*key, checked.alias("_v")).select(*key, "_v._x", "_v._c")

    outputs = F.array(F.col("_c")) if real_output else class_onehot(F.col("_c"), meta.n_output)
    spans = [(a.range_min, a.range_max) if a.kind == REAL else (0.0, 1.0) for a in meta.inputs]
    frame = rows.select(
        *key,
        F.col("_x").alias("inputs"),
        outputs.alias("outputs"),
        rescale_array(F.col("_x"), [lo for lo, _ in spans], [hi for _, hi in spans], on_zero_range).alias(
            "features"
        ),
        (label_from_onehot(outputs) if real_output else F.col("_c")).alias("label"),
    )
    return Dataset(frame, meta, tuple(key), name, raw=source)


def load_report(
    lines: DataFrame, meta: DatasetMeta, value: str = "value", compat: bool = True
) -> DataFrame:
    """One row that counts what a load would reject or mark, from one pass."""
    return _parsed_fields(lines, meta, [], value, trim_ends=not compat).agg(*_report_columns(meta, value))


def _report_columns(meta: DatasetMeta, value: str) -> list[Column]:
    bad_number = F.exists("_x", lambda x: x.isNull())
    flags = literal_array([a.kind != REAL for a in meta.inputs])
    unknown = F.zip_with("_x", flags, lambda x, is_nominal: is_nominal & (x < 0))
    unknown_nominal = F.exists(unknown, lambda u: u)
    if meta.output_kind == REAL:
        bad_number = bad_number | F.col("_c").isNull()
        unknown_class = F.lit(False)
    else:
        unknown_class = F.col("_c") < 0
    ok = F.col("_ok")
    bad = ~ok | bad_number | unknown_class
    return [
        F.count("*").alias("rows"),
        F.count_if(~ok).alias("wrong_field_count"),
        F.count_if(ok & bad_number).alias("bad_number"),
        F.count_if(ok & unknown_nominal).alias("unknown_nominal"),
        F.count_if(ok & unknown_class).alias("unknown_class"),
        F.min(F.when(bad, F.col(value))).alias("example"),
    ]


def read_header(spark: SparkSession, path: str, header_path: str | None = None) -> list[str]:
    """Header lines of the first file under ``path`` (or of ``header_path``).

    They count wherever they stand in that file, which is therefore read whole; only they
    reach the driver. Name a small ``header_path`` where the first file is large.
    """
    lines = spark.read.text(header_path or path)
    if header_path is None:
        first = min(lines.inputFiles(), default=None)
        if first is None:
            raise ValueError(f"no file under {path!r}")
        # The listing and the metadata column may spell a name in different ways: escaped or
        # not, and with or without an empty authority. A filter on that column leaves out the
        # other files without opening them, whatever the name holds.
        spellings = {first, unquote(first)}
        spellings |= {re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", s) for s in spellings}
        lines = lines.filter(F.col("_metadata.file_path").isin(*spellings))
    marked = F.lit(False)
    for mark in HEADER_MARKS:
        marked = marked | F.col("value").startswith(mark)
    in_order = lines.filter(marked).withColumn("_at", F.monotonically_increasing_id())
    return [row.value for row in in_order.orderBy("_at").collect()]


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header lines of every file under ``path``: ``file``, ``position`` (in the file's
    header), ``value``. Files without header lines have no row."""
    marked = F.lit(False)
    for mark in HEADER_MARKS:
        marked = marked | F.col("value").startswith(mark)
    lines = spark.read.text(path).filter(marked)
    # A block of a file is read by one task in order; blocks are told apart by their start.
    place = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    placed = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"))
    headers = placed.groupBy("file").agg(F.sort_array(F.collect_list("place")).alias("header"))
    return headers.select("file", F.posexplode("header.value").alias("position", "value"))


def declarations(spark: SparkSession, path: str) -> DataFrame:
    """The different declarations under ``path``: ``declaration`` (its attribute, input and
    output lines, blanks made alike), ``files`` that hold it, and the first of them as ``example``."""
    declared = file_headers(spark, path).filter(~F.col("value").startswith("@relation") & ~F.col("value").startswith("@data"))
    line = F.trim(F.regexp_replace(F.regexp_replace("value", r" *([{}\[\],]) *", "$1"), " +", " "))
    whole = declared.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("d"))
    return (
        whole.select("file", F.col("d.line").alias("declaration"))
        .groupBy("declaration")
        .agg(F.count("*").alias("files"), F.min("file").alias("example"))
    )


def require_one_declaration(spark: SparkSession, path: str) -> None:
    """Raise if files under ``path`` declare different attributes."""
    found = declarations(spark, path).orderBy("example").limit(2).collect()
    if len(found) > 1:
        a, b = found
        differ = next((x, y) for x, y in zip_longest(a.declaration, b.declaration) if x != y)
        raise ValueError(f"{b.example} declares {differ[1]!r} where {a.example} declares {differ[0]!r}")


def load_keel(
    spark: SparkSession,
    path: str,
    num_partitions: int | None = None,
    header_path: str | None = None,
    compat: bool = True,
    accept_real_output: bool | None = None,
    headers: str = "first",
    **options,
) -> Dataset:
    """Header, rows and rescale of a text file, directory or glob.

    The first file's header rules; with ``headers="same"`` every file is read for its header
    first, and one that declares anything else raises. Files without a header always may follow.
    ``options`` are those of :func:`parse_keel`. ``num_partitions`` asks for a shuffle of
    the lines and is for one small or unsplittable file.
    """
    if headers not in ("first", "same"):
        raise ValueError("headers must be 'first' or 'same'")
    if headers == "same":
        require_one_declaration(spark, path)
    accept = compat if accept_real_output is None else accept_real_output
    meta = parse_header(read_header(spark, path, header_path), accept)
    lines = spark.read.text(path)
    if num_partitions:
        lines = lines.repartition(num_partitions)
    options.setdefault("name", path)
    return parse_keel(lines, meta, compat=compat, **options)
