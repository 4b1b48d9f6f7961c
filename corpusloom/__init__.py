"""corpusloom: Spark-first operators that build, check and release a topic-scoped text corpus."""
