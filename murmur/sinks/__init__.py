"""Writers: partitioned files, appended documents and keyed upserts."""
