"""Job descriptions and the export plan built from them."""
