"""Sources: declared schemas, landing readers/writers, views over the test tables."""
