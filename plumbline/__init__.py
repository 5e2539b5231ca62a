"""plumbline: rule compliance and accessibility routing analytics on Spark."""
