"""Three-way reconciliation on Spark DataFrames, with a training-data toolkit in ``trisettle.llm``."""
