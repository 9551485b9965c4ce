"""Training-data operators: sharding, mixing, filtering, deduplication and tokenisation.

Nothing outside this subpackage imports it.  Executors import these modules by name, so on a cluster the
repository has to be on their PYTHONPATH (``--py-files`` or an installed wheel).
"""
