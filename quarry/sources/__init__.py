"""Files, parsers, settings and the mapping of tables onto the data model."""
