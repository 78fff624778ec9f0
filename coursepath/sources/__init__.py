from .local import local_table
from .readers import load_sources, preview, read_history, read_rules, scan_csv
from .schemas import HISTORY_SCHEMA, RULE_SCHEMA, SOURCE_SCHEMAS
from .writers import export_eligible, write_csv

__all__ = [
    "HISTORY_SCHEMA",
    "RULE_SCHEMA",
    "SOURCE_SCHEMAS",
    "export_eligible",
    "load_sources",
    "local_table",
    "preview",
    "read_history",
    "read_rules",
    "scan_csv",
    "write_csv",
]
