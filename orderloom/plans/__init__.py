"""Stage wiring: the full run, what-ifs and readouts built from the operators."""
