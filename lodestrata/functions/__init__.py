"""Column functions: native expressions, and Arrow-backed UDFs where there is no native form."""
