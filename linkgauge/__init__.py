"""linkgauge: network quality-of-service analytics as lazy PySpark DataFrame operators."""
