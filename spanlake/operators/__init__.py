"""DataFrame operators over interval-stamped rows; all are partitioned by episode (column ep)."""
