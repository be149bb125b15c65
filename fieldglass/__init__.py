"""Analytics over detections, tracks, pitch positions and annotation datasets, as Spark DataFrame operations."""
