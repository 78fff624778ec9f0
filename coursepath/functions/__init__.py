from .columns import (
    any_of_equals,
    class_key,
    clean_catalog_nbr,
    coerce_number,
    level_or_label,
    normalise_headers,
    not_nan,
    pad_to,
    strip_suffix,
    suffix_of,
    with_class_key,
    with_plan_flag,
)
from .order import packed_order

__all__ = [
    "any_of_equals",
    "class_key",
    "clean_catalog_nbr",
    "coerce_number",
    "level_or_label",
    "normalise_headers",
    "not_nan",
    "packed_order",
    "pad_to",
    "strip_suffix",
    "suffix_of",
    "with_class_key",
    "with_plan_flag",
]
