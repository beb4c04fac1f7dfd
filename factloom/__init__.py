"""factloom: a bitemporal, geospatial fact engine on PySpark."""
