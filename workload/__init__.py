"""Late-delivery test workload: views over the given tables, queries and SQL twins."""
