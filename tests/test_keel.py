"""The text loader, rule by rule."""

import math

import pytest

from quorum import load_keel, load_report, parse_header, parse_keel
from quorum.sources.keel import declarations, file_headers, read_header

IRIS = """@relation iris
@attribute sl real [4.0, 8.0]
@attribute sw real [2.0, 4.5]
@attribute pl real [1.0, 7.0]
@attribute pw real [0.0, 2.5]
@attribute class {setosa, versicolor, virginica}
@inputs sl, sw, pl, pw
@outputs class
@data
5.0, 3.5, 1.0, 0.5, setosa
6.0, 2.0, 4.0, 1.25, versicolor
8.0, 4.5, 7.0, 2.5, virginica
"""

MIXED = """@relation mixed
@attribute a real [0,10]
@attribute b integer [0,5]
@attribute c {low, mid, high}
@attribute y {no, yes}
@inputs a, b, c
@outputs y
@data
1.0, 5, low, no
2.5,0,high,yes
10 ,  3  ,  mid, no
"""


def head(attributes: str, inputs: str = "a", output: str = "y") -> str:
    return f"@relation t\n{attributes}\n@inputs {inputs}\n@outputs {output}\n@data\n"


def load(spark, text_file, text, **options):
    return load_keel(spark, text_file(text), **options)


def column(ds, name):
    return sorted(tuple(r[0]) if isinstance(r[0], list) else r[0] for r in ds.frame.select(name).collect())


def test_documented_shape(spark, text_file):
    ds = load(spark, text_file, IRIS)
    assert ds.meta.classes == ("setosa", "versicolor", "virginica")
    assert (ds.meta.n_input, ds.meta.n_output, ds.meta.n_attributes) == (4, 3, 7)
    rows = {r.label: r for r in ds.frame.collect()}
    assert rows[0.0].features == [0.25, 0.6, 0.0, 0.2]
    assert rows[2.0].features == [1.0, 1.0, 1.0, 1.0]
    assert rows[1.0].outputs == [0.0, 1.0, 0.0]
    assert [a.name for a in ds.meta.attributes[4:]] == ["setosa", "versicolor", "virginica"]
    assert {(a.io, a.range_min, a.range_max, a.values) for a in ds.meta.attributes[4:]} == {
        ("o", 0.0, 1.0, ("0", "1"))
    }


def test_nominal_inputs_are_codes_and_not_rescaled(spark, text_file):
    ds = load(spark, text_file, MIXED)
    assert column(ds, "inputs") == [(1.0, 5.0, 0.0), (2.5, 0.0, 2.0), (10.0, 3.0, 1.0)]
    assert column(ds, "features") == [(0.1, 1.0, 0.0), (0.25, 0.0, 2.0), (1.0, 0.6, 1.0)]
    nominal = ds.meta.inputs[2]
    assert (nominal.kind, nominal.range_min, nominal.range_max) == ("n", 0.0, 2.0)
    listed = ds.meta.attribute_table(spark).collect()
    assert [r.name for r in listed] == ["a", "b", "c", "no", "yes"]
    assert [r.io for r in listed] == ["i", "i", "i", "o", "o"]


def test_tight_brackets(spark, text_file):
    ds = load(spark, text_file, head("@attribute a real[0,10]\n@attribute y{p,q}") + "5,q\n")
    assert column(ds, "features") == [(0.5,)] and column(ds, "label") == [1.0]


def test_no_clipping(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + "-1, p\n0.5, p\n3, q\n"
    assert column(load(spark, text_file, text), "features") == [(-1.0,), (0.5,), (3.0,)]


def test_zero_range(spark, text_file):
    text = head("@attribute a real [2, 2]\n@attribute y {p, q}") + "2, p\n3, q\n"
    values = [v for (v,) in column(load(spark, text_file, text), "features")]
    assert any(math.isnan(v) for v in values) and math.inf in values
    zero = load(spark, text_file, text, on_zero_range="zero")
    assert column(zero, "features") == [(0.0,), (0.0,)]


def test_unknown_nominal_keeps_the_row(spark, text_file):
    text = head("@attribute a {u, v}\n@attribute y {p, q}") + "w, p\nv, q\n"
    assert column(load(spark, text_file, text), "inputs") == [(-1.0,), (1.0,)]


@pytest.mark.parametrize(
    "row, message",
    [
        ("0.5, z", "unknown class"),
        ("?, p", "not a number"),
        ("0.5", "wrong number of fields"),
        ("0.5, p, q", "wrong number of fields"),
    ],
)
def test_bad_rows_raise_or_are_dropped(spark, text_file, row, message):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + f"0.25, p\n{row}\n"
    with pytest.raises(Exception, match=f"{message}.*row"):
        load(spark, text_file, text).frame.collect()
    dropped = load(spark, text_file, text, on_bad_row="drop")
    assert column(dropped, "inputs") == [(0.25,)]


def test_blank_lines_and_lines_with_an_at_sign_are_no_rows(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + "0.25, p\n\n \t \n0.5, p@q\n0.75, q\n"
    assert column(load(spark, text_file, text), "inputs") == [(0.25,), (0.75,)]


def test_percent_lines_are_rows(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + "% note\n"
    with pytest.raises(Exception, match="wrong number of fields"):
        load(spark, text_file, text).frame.collect()


def test_empty_fields_at_the_end_do_not_count(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + "0.25, p, ,\n"
    assert column(load(spark, text_file, text), "label") == [0.0]


def test_trailing_space_belongs_to_the_class_in_compat_mode(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y {p, q}") + "0.25, q \n"
    with pytest.raises(Exception, match="unknown class"):
        load(spark, text_file, text).frame.collect()
    assert column(load(spark, text_file, text, compat=False), "label") == [1.0]
    assert column(load(spark, text_file, text, trim_line_ends=True), "label") == [1.0]


def test_real_output(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute y real [0, 5]") + "0.25, 1.0\n0.5, 2.0\n"
    ds = load(spark, text_file, text)
    assert column(ds, "label") == [-1.0, 0.0] and column(ds, "outputs") == [(1.0,), (2.0,)]
    assert (ds.meta.n_output, ds.meta.attributes[-1].kind) == (1, "r")
    with pytest.raises(ValueError, match="real"):
        load(spark, text_file, text, compat=False)


@pytest.mark.parametrize(
    "text, message",
    [
        ("@attribute a real [0, 1]\n@attribute y {p, q}\n@outputs y", "@inputs"),
        ("@attribute a real [0, 1]\n@attribute y {p, q}\n@inputs a", "@outputs"),
        ("@attribute a  real [0, 1]\n@attribute y {p}\n@inputs a\n@outputs y", "cannot read"),
        ("@attribute a real [0]\n@attribute y {p}\n@inputs a\n@outputs y", "range"),
        ("@attribute a\n@attribute y {p}\n@inputs a\n@outputs y", "cannot read"),
        ("@attribute a {4-NOT SPECIFIED, 5-LOW}\n@attribute y {p}\n@inputs a\n@outputs y", "space"),
        ("@attribute y {p, q}\n@attribute a real [0, 1]\n@inputs a\n@outputs y", "last"),
        ("@attribute a {p}\n@attribute y {p}\n@inputs\n@outputs a, y", "one output"),
        ("@attribute a real [0, 1]\n@attribute y {p}\n@inputs a, b\n@outputs y", "@inputs counts"),
    ],
)
def test_bad_headers(text, message):
    with pytest.raises(ValueError, match=message):
        parse_header(text.split("\n"))


def test_type_words_are_case_sensitive():
    meta = parse_header(["@attribute a Real [0, 1]", "@attribute y {p}", "@inputs a", "@outputs y"])
    assert meta.inputs[0].kind == "n" and meta.inputs[0].values == ("Real", "0", "1")


def test_directory_takes_the_header_of_its_first_file(spark, tmp_path):
    for name, row in (("a.dat", "1, 1, low, no"), ("b.dat", "2, 2, mid, yes")):
        header = MIXED.split("@data\n")[0] + "@data\n"
        (tmp_path / name).write_text(header + row + "\n")
    ds = load_keel(spark, str(tmp_path))
    assert ds.meta.n_input == 3 and ds.frame.count() == 2
    assert len(read_header(spark, str(tmp_path))) == 8


def test_header_without_data_mark(spark, text_file):
    text = IRIS.replace("@data\n", "")
    assert load(spark, text_file, text, num_partitions=3).frame.count() == 3


def test_load_report_counts(spark, text_file):
    text = head("@attribute a real [0, 1]\n@attribute b {u, v}\n@attribute y {p, q}", "a, b")
    text += "0.5, u, p\nx, u, p\n0.5, w, q\n0.5, u, z\n0.5, u\n"
    lines = spark.read.text(text_file(text))
    meta = parse_header(text.split("\n"))
    (report,) = load_report(lines, meta).collect()
    assert report.asDict() == {
        "rows": 5,
        "wrong_field_count": 1,
        "bad_number": 1,
        "unknown_nominal": 1,
        "unknown_class": 1,
        "example": "0.5, u",
    }


def test_rows_do_not_depend_on_the_partitions(spark, text_file):
    lines = spark.read.text(text_file(IRIS))
    meta = parse_header(IRIS.split("\n"))
    one = parse_keel(lines.coalesce(1), meta).frame.collect()
    many = parse_keel(lines.repartition(5), meta).frame.collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_wide_set_is_read_like_a_narrow_one(spark, text_file):
    """More attributes than are unrolled: same values, unknowns and failures."""
    n = 40
    kinds = ["{u, v}" if i % 3 == 0 else "real [0, 2]" for i in range(n)]
    header = head(
        "\n".join(f"@attribute a{i} {k}" for i, k in enumerate(kinds)) + "\n@attribute y {p, q}",
        ", ".join(f"a{i}" for i in range(n)),
    )
    row = ["v" if i % 3 == 0 else "1.5" for i in range(n)]
    unknown = ["w", *row[1:]]
    good = header + " , ".join([*row, "q"]) + "\n" + ",".join([*unknown, "p"]) + "\n"
    ds = load(spark, text_file, good)
    inputs = [1.0 if i % 3 == 0 else 1.5 for i in range(n)]
    assert column(ds, "inputs") == [(-1.0, *inputs[1:]), tuple(inputs)]
    assert column(ds, "features")[1] == tuple(1.0 if i % 3 == 0 else 0.75 for i in range(n))
    bad = header + ",".join([row[0], "x", *row[2:], "q"]) + "\n"
    with pytest.raises(Exception, match="not a number"):
        load(spark, text_file, bad).frame.collect()
    (report,) = load_report(spark.read.text(text_file(good)), ds.meta).collect()
    assert (report["rows"], report.unknown_nominal, report.bad_number) == (2, 1, 0)


def test_header_lines_count_wherever_they_stand(spark, text_file):
    """The same file with its last attribute after the rows, short and long."""
    for n in (100, 20_000):
        body = "0.5, a\n" * n
        text = "@attribute x real [0, 1]\n@inputs x\n@outputs c\n@data\n" + body + "@attribute c {a, b}\n"
        ds = load(spark, text_file, text, key="content")
        assert ds.meta.classes == ("a", "b") and ds.frame.count() == n


@pytest.mark.parametrize("name", ["a b.dat", "100%.dat", "x%20y.dat", "é ü.dat", "a+b.dat"])
def test_odd_file_names(spark, text_file, name):
    assert len(read_header(spark, text_file(IRIS, name))) == 9


def test_only_the_first_file_has_a_header(spark, tmp_path):
    (tmp_path / "a 1.dat").write_text(IRIS)
    (tmp_path / "b 2.dat").write_text("@attribute other real [0, 1]\n6.0, 2.0, 4.0, 1.25, virginica\n")
    ds = load_keel(spark, str(tmp_path))
    assert ds.meta.n_input == 4 and ds.frame.count() == 4


def test_equal_lines_draw_apart(spark, text_file):
    """Four distinct lines, a thousand times each, without a key."""
    from quorum import ModelSpec, bagging, stacking
    from quorum.operators import sampling

    lines = "".join(f"{x}, {n}\n" for x in (0, 1) for n in "ab") * 1000
    text = head("@attribute a integer [0, 1]\n@attribute y {a, b}") + lines
    ds = load(spark, text_file, text)
    assert ds.key == ()
    nb = ModelSpec.of("NB", 1.0)
    result = bagging(ds, [nb, nb])
    assert abs(result.predictions.count() / 4000 - 0.4) < 0.03
    assert result.predictions.count() == result.predictions.count()
    assert stacking(ds, [nb, nb], nb).predictions.count() > 0
    weights = sampling.with_bag_weights(ds.frame, [], 1, method="random").select("bag0").toPandas()["bag0"]
    assert abs(weights.mean() - 0.66) < 0.05 and abs(weights.var() - 0.66) < 0.08
    folds = ds.frame.select(sampling.fold_column([], method="random").alias("f")).distinct().count()
    assert folds == 10
    same = load(spark, text_file, text, key="content")
    assert same.key == ("row_id",) and same.frame.select("row_id").distinct().count() == 4


def test_copies_draw_apart_and_alike_in_any_order(spark, tmp_path, monkeypatch):
    """Equal lines in one file, in many, shuffled, and with a line in several blocks."""
    from quorum import ModelSpec, bagging
    from quorum.operators import sampling
    from quorum.plans import runs

    top = head("@attribute a integer [0, 1]\n@attribute y {a, b}")
    lines = [f"{x}, {n}\n" for x in (0, 1) for n in "ab" for _ in range(600 if x else 50)] + ["1,a\n"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.dat").write_text(top + "".join(lines))
    (tmp_path / "many").mkdir()
    for i in range(5):
        (tmp_path / "many" / f"{i}.dat").write_text(top + "".join(reversed(lines[i::5])))

    def drawn(path, **options):
        ds = load_keel(spark, str(tmp_path / path), key="copy", **options)
        rows = sampling.with_bag_weights(sampling.with_part(ds.frame, ds.key), ds.key, 1)
        return sorted(map(str, rows.withColumn("fold", sampling.fold_column(ds.key)).collect()))

    expected = drawn("one")
    assert len(expected) == len(lines) and len({r.split("row_id='")[1][:32] for r in expected}) == len(lines)
    monkeypatch.setattr(sampling, "COPY_BLOCK", 7)
    assert drawn("many") == expected and drawn("one", num_partitions=3) == expected

    def stored(*_):
        raise AssertionError("rows with a key of their own are written down")

    monkeypatch.setattr(runs, "checkpointed", stored)
    nb = ModelSpec.of("NB", 1.0)
    result = bagging(load_keel(spark, str(tmp_path / "many"), key="copy"), [nb, nb])
    assert abs(result.predictions.count() / len(lines) - 0.4) < 0.05
    folds = {r.split("fold=")[1] for r in expected}
    assert len(folds) == 10


def test_counts_and_narrow_reads_check_the_rows(spark, text_file):
    from quorum.operators.prepare import dataset_summary, nominal_value_counts

    top = head("@attribute a {u, v}\n@attribute y {p, q}")
    for bad in ("u, z", "u", "u, p, p"):
        ds = load(spark, text_file, top + "u, p\n" + bad + "\n")
        for read in (dataset_summary(ds), nominal_value_counts(ds), ds.frame.select("label"), ds.frame.select("inputs")):
            with pytest.raises(Exception, match="row"):
                read.collect()
        kept = load(spark, text_file, top + "u, p\n" + bad + "\n", on_bad_row="drop")
        assert dataset_summary(kept).first()["n_instances"] == 1


def test_files_that_declare_something_else(spark, tmp_path):
    head = "@relation r\n@attribute x real [0, 1]\n@attribute c {a, b}\n@inputs x\n@outputs c\n@data\n"
    spaced = head.replace("[0, 1]", "[0,1]").replace("{a, b}", "{a,b}").replace("relation r", "relation other")
    for name, text in (("1.dat", head + "0.5, a\n"), ("2.dat", spaced + "0.25, b\n"), ("3.dat", "0.75, a\n")):
        (tmp_path / name).write_text(text)
    path = str(tmp_path)
    assert sorted(r.features[0] for r in load_keel(spark, path, headers="same").frame.collect()) == [0.25, 0.5, 0.75]
    (found,) = declarations(spark, path).collect()
    assert found.files == 2 and found.declaration[0] == "@attribute x real[0,1]"
    positions = [r.position for r in file_headers(spark, path).orderBy("file", "position").collect()]
    assert positions == [0, 1, 2, 3, 4, 5] * 2

    (tmp_path / "4.dat").write_text(head.replace("[0, 1]", "[0, 2]") + "1.5, b\n")
    with pytest.raises(ValueError, match=r"4\.dat declares '@attribute x real\[0,2\]'"):
        load_keel(spark, path, headers="same")
    assert load_keel(spark, path).frame.count() == 4
    assert declarations(spark, path).count() == 2
    with pytest.raises(ValueError, match="headers must be"):
        load_keel(spark, path, headers="any")
