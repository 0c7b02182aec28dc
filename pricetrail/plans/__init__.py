"""How operators are combined and kept balanced: slicing, small joins, lineage, whole runs."""
