"""Partition-key pruning for Spark: fragments, stored key sets, pruned queries."""
