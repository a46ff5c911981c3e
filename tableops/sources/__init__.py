from tableops.sources.csv import detect_sep, normalize_header, read_csv, write_csv
from tableops.sources.exports import read_exports
from tableops.sources.files import preview, preview_files, read_file, read_parquet_ordered
from tableops.sources.ingest import null_tokens, numeric_cells, promote_numeric
from tableops.sources.workbooks import read_workbooks

__all__ = [
    "detect_sep",
    "normalize_header",
    "null_tokens",
    "numeric_cells",
    "preview",
    "preview_files",
    "promote_numeric",
    "read_csv",
    "read_exports",
    "read_file",
    "read_parquet_ordered",
    "read_workbooks",
    "write_csv",
]
