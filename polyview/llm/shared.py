"""Staging for the operators of this subpackage; see ``polyview.functions.staging``."""

from polyview.functions.staging import drop_table, drop_tables, read_tables, shared_dir, shuffle_partitions, stage_table

__all__ = ["drop_table", "drop_tables", "read_tables", "shared_dir", "shuffle_partitions", "stage_table"]
