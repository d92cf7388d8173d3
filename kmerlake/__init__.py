"""kmerlake: k-mer containment, abundance and read classification on Spark DataFrames."""
