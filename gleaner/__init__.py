"""gleaner: document-discovery analytics on Spark."""
