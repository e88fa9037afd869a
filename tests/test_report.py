import pytest

from conftest import SF_SMALL
from quorum import ModelSpec, report_lines, run_report, stacking, write_report
from quorum.checks import datasets as sets

NB = ModelSpec.of("NB", 1.0)


@pytest.fixture(scope="module")
def report(spark):
    ds = sets.lineitem_dominant(spark, SF_SMALL)
    return run_report(stacking(ds, [NB, NB], NB, num_partitions=2))


def test_content(report):
    (row,) = report.collect()
    assert (row.run, row.input, row.num_partitions) == ("stacking", "lineitem_dominant", 2)
    assert row.level0_models == ["NB 1.0", "NB 1.0"] and row.level1_model == "NB 1.0"
    assert row.accuracy == row["right"] / row["total"]
    assert row.total_seconds >= row.execution_seconds > 0


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_round_trip(spark, report, tmp_path, format):
    path = str(tmp_path / format)
    write_report(report, path, format)
    back = spark.read.format(format).load(path).select(report.columns)
    assert back.collect() == report.collect()


def test_text(spark, report, tmp_path):
    path = str(tmp_path / "text")
    write_report(report, path, "text")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == [r.value for r in report_lines(report).collect()]
    assert lines[:5] == [
        "Input: lineitem_dominant",
        "Partitions: 2",
        "Level-0 models:",
        "NB 1.0",
        "NB 1.0",
    ]
    assert lines[5] == "Level-1 model: NB 1.0" and len(lines) == 9
    with pytest.raises(ValueError):
        write_report(report, path, "xml")
