"""reliq: test-reliability analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames. ``now`` is always an
argument; nothing reads the wall clock.
"""
