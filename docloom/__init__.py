"""docloom: document analytics as Spark plans."""
