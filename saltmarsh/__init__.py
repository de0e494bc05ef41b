"""Analytics over archived web content on Spark: extraction, robots rules, job queue, merges and reports."""
