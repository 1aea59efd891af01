"""NumPy kernels over the pairs of many frames at once, run on Arrow batches."""
