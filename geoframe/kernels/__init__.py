"""NumPy kernels that run within one group of rows."""
