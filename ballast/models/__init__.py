"""Spark ML estimators that rebalance their training part, tuning and scoring."""
