"""See the README for the operators kept here."""
