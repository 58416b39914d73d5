"""kinsieve: near-duplicate detection, reconciliation and task-queue folds on Spark DataFrames."""
