"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it. Each module holds one operator
with a general interface; ``queries`` derives the registered result tables.
"""
