"""braid: document analytics and payment-stream analytics as Spark jobs."""
