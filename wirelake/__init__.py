"""Network traffic analytics as Spark jobs: captures to segments, messages, round trips, metrics and spans."""
