"""tidelog: durable, ordered event logs as DataFrames."""
