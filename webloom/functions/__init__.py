"""Column functions: text, language, addresses, codecs, HTML."""
