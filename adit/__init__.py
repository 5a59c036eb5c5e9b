"""Survey-geometry analytics and training-data preparation as Spark jobs."""
