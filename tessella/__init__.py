"""tessella: evidence analytics over tables, written as Spark DataFrame programs."""
