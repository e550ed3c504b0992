"""Dataset-understanding jobs for Spark: profile, prune, resolve, validate and materialise tables."""
