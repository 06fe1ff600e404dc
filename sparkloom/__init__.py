"""sparkloom: corpus preparation and answer judging as Spark DataFrame plans."""
