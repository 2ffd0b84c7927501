"""Star-schema tables: fixed schemas, readers and the CSV loader."""
