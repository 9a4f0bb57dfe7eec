"""swathline: line-scanner (hyperspectral pushbroom) analytics on Spark DataFrames."""
