"""undula: Spark jobs over very large collections of audio signals held as tables."""
