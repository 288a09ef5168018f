"""loomtext: corpus-scale analytics for translated documents on Apache Spark."""
