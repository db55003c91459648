"""Sievewright: document-matching analytics expressed as Spark DataFrame plans."""
