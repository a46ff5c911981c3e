from tableops.functions.numbers import approx_equal, exact_gap, exact_sum, to_flag, to_number, to_whole
from tableops.functions.text import as_text, clean_text, slug, strip_ws

__all__ = [
    "approx_equal",
    "as_text",
    "clean_text",
    "exact_gap",
    "exact_sum",
    "slug",
    "strip_ws",
    "to_flag",
    "to_number",
    "to_whole",
]
