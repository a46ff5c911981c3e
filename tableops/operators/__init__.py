from tableops.operators.cleaning import CleanSpec, clean, dedupe, drop_missing, fill_missing, report, standardize
from tableops.operators.comparison import CompareResult, align_keys, compare
from tableops.operators.filters import distinct_values, filter_eq, total
from tableops.operators.profile import column_profile, numeric_columns, shape
from tableops.operators.project import keep_and_rename
from tableops.operators.split import manifest, parts, read_parts, split_write
from tableops.operators.grouping import summarize
from tableops.operators.lookup import duplicate_keys, unify

__all__ = [
    "CleanSpec",
    "CompareResult",
    "align_keys",
    "clean",
    "column_profile",
    "compare",
    "dedupe",
    "distinct_values",
    "drop_missing",
    "duplicate_keys",
    "fill_missing",
    "filter_eq",
    "keep_and_rename",
    "manifest",
    "numeric_columns",
    "parts",
    "read_parts",
    "report",
    "shape",
    "split_write",
    "standardize",
    "summarize",
    "total",
    "unify",
]
