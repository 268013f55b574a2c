"""lamella: multilayer-graph analytics expressed as Spark DataFrame plans."""
