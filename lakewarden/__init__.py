"""lakewarden: a Spark-first text-safety analytics engine.

Every operator takes and returns DataFrames; nothing here starts a job unless
its docstring says so.
"""
