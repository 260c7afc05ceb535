"""Order economics and reconciliation as lazy Spark plans."""
