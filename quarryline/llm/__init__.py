"""Training-data operators: whole-corpus text preparation on Spark.

Nothing outside this subpackage imports it. Heavy text work runs in Arrow
batches on numpy; joins, groupings and exchanges stay Spark's.
"""
