"""Gene-sharing graph, taxonomy and label-transfer analytics as Spark jobs."""
