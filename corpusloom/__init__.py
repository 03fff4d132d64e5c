"""corpusloom: Spark-native analytics over corpora of written text."""
