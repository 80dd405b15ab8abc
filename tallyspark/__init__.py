"""A PySpark engine for usage telemetry of language-model APIs."""
