"""granary: a PySpark-native engine for curating language-model training text."""
