"""tempora: prediction and evaluation of many time series as Spark jobs."""
