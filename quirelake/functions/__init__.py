"""Column builders and the few pure-Python kernels behind Arrow UDFs."""
