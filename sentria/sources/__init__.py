"""Table sources and sinks."""

from sentria.sources.tables import shared_dir, read_table, with_columns_only, written

__all__ = ["read_table", "shared_dir", "with_columns_only", "written"]
