"""Transcription QA at corpus scale on Spark DataFrames."""
