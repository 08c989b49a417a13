"""helixframe: guide-design analytics expressed as Spark DataFrame plans."""
