"""Layer plans: silver, the gold metrics, the pipeline and the registered queries."""
