"""Scalar functions from Column to Column, all inside the JVM."""
