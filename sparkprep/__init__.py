"""sparkprep: dataset preparation, profiling and distribution on PySpark."""

__version__ = "0.1.0"
