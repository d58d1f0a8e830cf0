"""Packet-traffic analytics on Spark: rules, counters, rates, alarms."""
