"""docloom: document extraction, chunking, ranking, grading and corpus preparation on Spark."""
