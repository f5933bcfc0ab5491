"""Document comparison at cluster scale, as Spark DataFrame plans over tables of original/modified pairs."""
