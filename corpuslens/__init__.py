"""Analytics over large document corpora as Spark jobs."""
