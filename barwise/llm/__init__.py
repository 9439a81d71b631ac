"""Operators of a training-data pipeline over the ``documents``, ``embeddings``,
``pages``, ``benchmark`` and ``labels`` tables. Nothing outside this subpackage
imports it; ``__spark_entry__.py`` registers its queries when it is present."""
