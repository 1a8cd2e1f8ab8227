"""Sources and sinks: explicit-schema CSV of the basket tables, the test-data adapter."""

from .csv import read_csv, read_table, read_tables, write_csv
from .testdata import GRAINS, load

__all__ = ["read_csv", "read_table", "read_tables", "write_csv", "GRAINS", "load"]
