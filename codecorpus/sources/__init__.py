"""Reading corpora and commit logs into tables keyed by ``repo`` and ``path``."""
