"""How plans are carried out: what executors need, and how results are kept."""
