"""tracelake: a provenance catalog engine made of Spark DataFrame operators."""
