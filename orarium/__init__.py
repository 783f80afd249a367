"""Opening-hours and roster analytics as Spark DataFrame jobs."""
