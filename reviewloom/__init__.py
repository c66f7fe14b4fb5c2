"""Review mining as Spark jobs: clean, score, find topics, report by brand."""
