"""routeloom: a Spark engine for evaluating query routing, plus training-data operators in `llm`."""

__version__ = "0.1.0"
