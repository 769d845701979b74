"""Code and document analytics on Spark: entity tables, search, graphs, references and incremental upkeep."""
