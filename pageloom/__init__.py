"""pageloom: web-content analytics as Spark jobs over whole tables."""
