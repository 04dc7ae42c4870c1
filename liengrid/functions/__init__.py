"""Spark SQL expressions, built as text from the text of their inputs.

Composing an expression from Column objects costs the driver several calls to the JVM
per operator; one text is parsed in a single call. Nothing here runs a job.
"""
