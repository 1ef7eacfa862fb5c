"""Output tables and registered queries composed from the operators."""
