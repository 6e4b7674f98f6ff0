"""The estimator, the two-stage experiment, and the registered queries."""
