"""Readers and writers of the domain's file formats; tables come from any Spark source."""
