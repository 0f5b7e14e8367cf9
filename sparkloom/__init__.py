"""sparkloom: DataFrame operators for tool-use conversations and synthetic linear-algebra data."""

__version__ = "0.1.0"
