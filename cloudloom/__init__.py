"""Point-cloud analytics and compression expressed as Spark jobs."""
