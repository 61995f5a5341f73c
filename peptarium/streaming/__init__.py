"""No streaming operators: every job this engine covers is a bounded batch.

Incremental work is done with batch anti joins (``operators.joins.new_peptides``,
``operators.joins.pending``) and dynamic partition overwrite (``sinks.tables.write_component``).
"""
