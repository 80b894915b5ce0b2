"""Conversational-intervention analytics on Spark: lazy DataFrame -> DataFrame operators."""
