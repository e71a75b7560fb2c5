"""From a question to a typed query specification, its SQL, and the guard on foreign SQL; no rows are touched."""
