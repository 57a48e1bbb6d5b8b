"""Graph operators: DataFrame in, DataFrame out."""
