"""Reading and writing tables, files and views."""
