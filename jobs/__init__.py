"""Runnable jobs: each reads tables by path, writes partitioned output, logs both, and reruns with the same result."""
