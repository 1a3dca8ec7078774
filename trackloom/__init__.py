"""trackloom: keyed time tracks, ordered text and intervals as Spark DataFrame operators."""
