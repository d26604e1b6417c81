"""Column functions: normalisation, tokens, predicates, markup, phonetics, distances."""
