"""Transactional workloads as dataflow on Spark: state is the ordered fold of an operation log."""
