"""Analytics on threaded-discussion archives, expressed as Spark plans."""
