"""Quorum: training, combining and scoring ensembles of classifiers on Spark."""

from quorum.operators.evaluate import accuracy
from quorum.operators.models import fit, make_estimator
from quorum.operators.prepare import (
    dataset_summary,
    labelled_points,
    nominal_value_class_counts,
    nominal_value_counts,
)
from quorum.plans.report import report_lines, run_report, write_report
from quorum.plans.runs import RunResult, bagging, single_model, stacking
from quorum.schema import Attribute, Dataset, DatasetMeta, ModelSpec, nominal, real
from quorum.sources.keel import load_keel, load_report, parse_header, parse_keel
from quorum.sources.tables import from_array_table, from_table

__all__ = [
    "Attribute",
    "Dataset",
    "DatasetMeta",
    "ModelSpec",
    "RunResult",
    "accuracy",
    "bagging",
    "dataset_summary",
    "fit",
    "from_array_table",
    "from_table",
    "labelled_points",
    "load_keel",
    "load_report",
    "make_estimator",
    "nominal",
    "nominal_value_class_counts",
    "nominal_value_counts",
    "parse_header",
    "parse_keel",
    "real",
    "report_lines",
    "run_report",
    "single_model",
    "stacking",
    "write_report",
]
