"""Document-graph analytics on Spark: DataFrame-to-DataFrame operators for document corpora."""
