"""Rule tables. Every operator takes its rules as an argument; these are the defaults."""
