"""eventlake: relational operators for event-log data on Apache Spark."""
