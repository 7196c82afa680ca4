"""Column expressions: names, regions, composition, classes, number formats, copy-number mathematics."""
