"""polyview: multi-view vector retrieval, pose ensembles and cache analytics as Spark plans."""
