"""A labelled-property-graph analytics engine on Spark DataFrames."""
