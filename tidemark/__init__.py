"""tidemark: a PySpark-native engine that holds source trees and text tables against a written standard."""

__version__ = "0.1.0"
