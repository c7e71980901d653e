"""Sessions, order keys, fluent pipelines and the registered queries."""
