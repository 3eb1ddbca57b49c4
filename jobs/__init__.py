"""Runnable jobs: each reads tables by path and writes partitioned output that later runs can repeat or carry on."""
