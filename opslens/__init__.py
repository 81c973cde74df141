"""Fleet operations telemetry analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames.  Nothing is ever executed against
a server: decisions come back as action-plan rows with a ``command_text``.
"""
