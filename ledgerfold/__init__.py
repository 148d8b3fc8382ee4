"""A PySpark-native engine that copies keyed tables, replays change logs onto
them and verifies the outcome."""
