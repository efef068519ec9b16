"""Column functions: every one maps a Column to a Column and stays inside the row."""
