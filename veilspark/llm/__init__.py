"""Training-data operators: filters, de-duplication, scoring, formatting, mixing and packing."""
