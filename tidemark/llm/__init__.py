"""Training-data operators: one module for each, registered in ``registry``."""
