"""Column functions: text normalisation, stems, labels."""
