"""kgloom: knowledge-graph analytics over text, declared as Spark DataFrames."""
