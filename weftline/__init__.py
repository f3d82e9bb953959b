"""Workspace lineage, impact and code-quality analytics as Spark jobs.

Every capability is a plain function from DataFrames to DataFrames:

* ``weftline.sources``    read notebooks, definitions, logs and files; write reports
* ``weftline.functions``  column expressions (names, SQL text, diagnosis, severity)
* ``weftline.operators``  cells, lineage, graph, reachability, impact, review, runs, inventory
* ``weftline.streaming``  the same expressions kept current by Structured Streaming
* ``weftline.plans``      derived corpora, registered queries and their reference SQL
"""
