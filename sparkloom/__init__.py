"""Machine learning, mining and corpus work as ordinary Spark queries."""
