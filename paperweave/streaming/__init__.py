"""Change data and stateful stream operators."""
