"""Files in and out, and captured search-result bodies."""
