"""Series, quality, join, metric, diagnosis and dispatch operators."""
