"""Page-layout and text-region analytics on PySpark DataFrames."""
