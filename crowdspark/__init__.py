"""People-flow analytics and corpus preparation as Spark jobs."""
