"""tidewire: a PySpark-native engine that turns scattered local-news posts into
deduplicated, geolocated events, and prepares text corpora for model training."""

__version__ = "0.1.0"
