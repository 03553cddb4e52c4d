"""Concordia: merging evidence from many independent logs, as Spark plans."""
