"""Numpy kernels that run inside Spark tasks, and their DataFrame wrappers."""
