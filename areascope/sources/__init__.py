"""Sources and sinks: CSV feed folders, tables, reports, models."""

from .files import (RAW_SCHEMAS, cached, feed_inventory, feed_parts, file_inventory, files_version, refresh, require_columns,
                    scan_feed, scan_table, select_existing)
from .sinks import export_report, save_models, write_outputs, write_report, write_table

__all__ = ["RAW_SCHEMAS", "cached", "refresh", "feed_inventory", "feed_parts", "file_inventory", "files_version", "require_columns", "scan_feed", "scan_table",
           "select_existing", "export_report", "save_models", "write_outputs", "write_report",
           "write_table"]
