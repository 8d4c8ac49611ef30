"""Ion files as DataFrames, schema documents from a table, and sinks."""

from assayer.sources.ion import TableAuthority, catalogue, read_ion, schema_issues, write_ion

__all__ = ["TableAuthority", "catalogue", "read_ion", "schema_issues", "write_ion"]
