"""mediaframe: video-decode analytics as Spark DataFrame functions."""
