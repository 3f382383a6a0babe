"""vellum: document-intelligence analytics as Spark DataFrame operators."""
