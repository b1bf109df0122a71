"""Annotated-image-tile analytics as Spark DataFrame operators."""
