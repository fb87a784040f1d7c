"""Column functions and the small NumPy kernels used inside tasks."""
