"""granary: which records should a fleet of storage-limited nodes keep?

A PySpark-native engine. ``granary.operators`` holds the DataFrame operators,
``granary.sources`` scans and sinks, ``granary.functions`` column expressions,
``granary.plans`` the registered queries and ``granary.streaming`` the stateful
and streaming forms. ``granary.llm`` is a separate set of training-data
operators; nothing else in the package imports it.
"""
