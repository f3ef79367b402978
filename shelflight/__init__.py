"""Stock-record analytics on Spark: load, normalise, check, report."""

from shelflight.plans.load import append_records, load_star
from shelflight.plans.reports import REPORTS, record_report, refresh_reports
from shelflight.session import prepare
from shelflight.star import Star
from shelflight.storage import read_star, settled_tables, slice_rows, write_star

__all__ = [
    "REPORTS",
    "Star",
    "append_records",
    "load_star",
    "prepare",
    "read_star",
    "record_report",
    "refresh_reports",
    "settled_tables",
    "slice_rows",
    "write_star",
]
