"""Rule trees compiled to column expressions, and plan tables of file actions."""
