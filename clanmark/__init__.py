"""Grouping and identification of entities from vectors, as Spark DataFrame operators.

A *detection* is one vector observation inside an *asset*; a *cluster* is a set of
detections taken to be one entity; a *profile* is a known, labelled vector.
"""
