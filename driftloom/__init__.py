"""driftloom: Spark operators for analysing how concepts drift through large text corpora."""
