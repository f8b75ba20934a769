"""Column-expression builders (``scalars``) and fixed values (``constants``)."""
