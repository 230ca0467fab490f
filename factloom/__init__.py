"""factloom: sourced entity facts as Spark DataFrames."""
