"""quire: document retrieval and analytics as Spark DataFrame plans."""
