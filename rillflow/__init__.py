"""rillflow: network-flow analytics expressed as Spark DataFrame plans."""
