"""Column functions: text, prompts and display."""
