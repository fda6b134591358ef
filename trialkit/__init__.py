"""Long tables of ranked responses on Spark: summaries, trimming, crossings and inference tables."""
