"""Set-oriented temporal operators: each answers for all keys at once."""
