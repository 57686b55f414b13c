"""granary: file and document catalogues as Spark DataFrames."""
