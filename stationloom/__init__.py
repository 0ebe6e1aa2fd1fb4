"""Quality control and analysis of station panels, expressed as Spark plans."""
