"""The jobs applied to the supplied tables, each with the SQL that must give the same rows."""
