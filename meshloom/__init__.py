"""Mesh analytics on Spark: meshes are vertex and face tables, operators are DataFrame plans."""
