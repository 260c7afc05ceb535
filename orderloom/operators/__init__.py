"""One module per stage; every function takes and returns DataFrames."""
