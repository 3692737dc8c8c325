"""gramloom: n-gram language data on Spark - counting, cumulative models, coding and streaming."""
