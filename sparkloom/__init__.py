"""sparkloom: graph sampling, message passing and measurement analytics as Spark DataFrame plans."""
