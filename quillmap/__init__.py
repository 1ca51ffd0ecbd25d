"""quillmap: a PySpark-native engine for collections of embedding vectors, their graphs and maps."""

__version__ = "0.1.0"
