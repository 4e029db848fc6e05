"""Classification of OWL 2 EL ontologies with Spark DataFrames."""
