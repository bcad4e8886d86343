"""Web-archive analytics on Spark: captures, URL keys, snapshot resolution and link rewriting."""
